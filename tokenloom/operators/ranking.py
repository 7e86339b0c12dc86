"""Deterministic top-k, ranks, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import reciprocal_rank


def top_k(hits: DataFrame, k: int, *, score: str = "score", id: str = "uuid") -> DataFrame:
    """The k best by (score descending, id ascending): one TakeOrderedAndProject."""
    return hits.orderBy(F.desc(score), F.asc(id)).limit(max(k, 0))


def ranked(hits: DataFrame, *, score: str = "score", id: str = "uuid", rank: str = "rank") -> DataFrame:
    """Ranks from 1. For lists that top_k has cut; the window has no partition."""
    return hits.withColumn(rank, F.row_number().over(W.orderBy(F.desc(score), F.asc(id))))


def top_k_per_query(hits: DataFrame, k: int, *, query: str = "query_id", score: str = "score", id: str = "uuid") -> DataFrame:
    """Ranks up to k within each query, the excess dropped before the shuffle (WindowGroupLimit)."""
    w = W.partitionBy(query).orderBy(F.desc(score), F.asc(id))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(vector: DataFrame, text: DataFrame, *, top: int, budget: int = 50, k: int = 60) -> DataFrame:
    """Hybrid hits of two scored lists: uuid, score, vector_rank, vector_score, fts_rank, fts_score."""
    v = ranked(top_k(vector, budget)).select("uuid", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    t = ranked(top_k(text, budget)).select("uuid", F.col("rank").alias("fts_rank"), F.col("score").alias("fts_score"))
    both = v.join(t, "uuid", "full_outer")
    score = reciprocal_rank("vector_rank", k) + reciprocal_rank("fts_rank", k)
    return top_k(both.withColumn("score", score), top).select("uuid", "score", "vector_rank", "vector_score", "fts_rank", "fts_score")
