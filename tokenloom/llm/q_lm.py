"""Query of language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, texts
from .lm import score


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 7)
    scored = score(docs, remainder != 2, remainder == 5)
    held_out = F.coalesce(fold(F.col("doc_id"), 7) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
