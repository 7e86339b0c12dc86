"""Query of SimHash near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import texts
from .simhash import near_duplicates


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(texts(spark, sf_dir, "documents").select("doc_id", "text"))
