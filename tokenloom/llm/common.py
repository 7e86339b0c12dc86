"""Helpers that the operators of this package share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir, scratch_path
from ..sources.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts to work through, on all cores even if it is one small file."""
    return spread(table(spark, sf_dir, name))


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that materialise() returned and that no later plan reads."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of finished steps: Spark deletes their shuffle files once the driver's handles of them are collected.

    Those of the step before are held until another job has run, so a small one runs here.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_size(few: DataFrame, most: int = 200_000) -> DataFrame:
    """A narrow written table, to be broadcast if it is counted and found to have at most so many rows; joined as it is otherwise."""
    return F.broadcast(few) if few.limit(most + 1).count() <= most else few


def free_name(df: DataFrame, wanted: str) -> str:
    """wanted, or a variant of it that no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def chunks(sizes: list[int], budget: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to at most budget, at least one row each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


__all__ = ["chunks", "discard", "fold", "free_name", "materialise", "release", "scratch_dir", "scratch_path", "table", "texts", "with_size"]
