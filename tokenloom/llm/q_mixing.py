"""Query of mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts
from .mixing import plan_mix


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "source", "text")
    plan = plan_mix(docs)
    return plan.select(
        F.col("id_").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("size_").alias("size"),
        F.col("source_size_").alias("source_size"),
        F.col("target_").alias("target"),
        (F.col("copies_") * F.col("size_")).alias("taken"),
        F.explode(F.array_repeat(F.col("source_"), F.col("rows_").cast("int"))).alias("source"),
    )
