"""Query of language identification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, texts
from .langid import identify


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    found, name = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), F.col(f"{name}.lang").alias("lang_pred"), F.col(f"{name}.score").alias("score"))
