"""Query of HTML extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts
from .htmltext import extract_text


def op7_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_text(texts(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "n_marked")
