"""Generations of the token index: the cascade, its winner per chunk, and integrity checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class IndexConfig:
    """base and fanout: capacity of level L is base * fanout**(L + 1) tokens."""

    base: int = 1024
    fanout: int = 16
    iterations: int = 5
    coefficient: float = 16.0
    seed: int = 42

    def __post_init__(self) -> None:
        if self.base < 1 or self.fanout < 2 or self.iterations < 1 or self.coefficient <= 0:
            raise ValueError("base, iterations and coefficient must be positive and fanout at least 2")

    def capacity(self, level: int) -> int:
        return self.base * self.fanout ** (level + 1)


def cascade_level(pending: int, level_tokens: dict[int, int], config: IndexConfig = IndexConfig()) -> int:
    """Level that takes the pending tokens and those of all levels up to it without exceeding its capacity."""
    total, level = pending, 0
    while True:
        total += level_tokens.get(level, 0)
        if total <= config.capacity(level):
            return level
        level += 1


def level_sums(generations: DataFrame) -> DataFrame:
    return generations.groupBy("level").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_generations"))


def chunk_ranges(postings: DataFrame) -> DataFrame:
    return postings.groupBy("gen").agg(F.min("chunk_id").alias("min_chunk"), F.max("chunk_id").alias("max_chunk"), F.count("*").alias("n_tokens"))


def overlapping(generations: DataFrame, low: int, high: int) -> DataFrame:
    """Generations whose chunk range meets [low, high]."""
    return generations.where((F.col("min_chunk") <= high) & (F.col("max_chunk") >= low))


def conflicts(postings: DataFrame) -> DataFrame:
    """Chunks that occur in more than one generation."""
    return postings.groupBy("chunk_id").agg(F.count_distinct("gen").alias("n_generations")).where("n_generations > 1")


def winners(postings: DataFrame, generations: DataFrame) -> DataFrame:
    """(chunk_id, gen): where each chunk stays after recovery, by level, then age, then id, the highest first."""
    held = postings.select("chunk_id", "gen").distinct().join(generations.select("gen", "level", "created"), "gen")
    order = W.partitionBy("chunk_id").orderBy(F.desc("level"), F.desc("created"), F.desc("gen"))
    return held.withColumn("place", F.row_number().over(order)).where("place = 1").select("chunk_id", "gen")


def recovered(postings: DataFrame, generations: DataFrame) -> DataFrame:
    """Postings without those of a chunk outside its winning generation."""
    return postings.join(winners(postings, generations), ["chunk_id", "gen"], "left_semi")


def fingerprint(generations: DataFrame) -> DataFrame:
    """One row that tells whether an index is the one a snapshot was taken of."""
    return generations.agg(
        F.coalesce(F.max("max_chunk"), F.lit(0)).alias("max_chunk"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.max("gen"), F.lit(0)).alias("max_gen"), F.count("*").alias("n_generations"),
    )
