"""Spherical k-means over token vectors.

The distance work is a blocked matrix product in Arrow batches: an expression
over arrays would cost one interpreted loop per point and centroid. Centroids
number about 16 times the square root of the points; they are broadcast in blocks
of a bounded size, one pass over the points for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.vectors import norm

#: Bytes of centroids in one broadcast, and rows of points in one product.
BLOCK_BYTES, TILE = 128 << 20, 4096


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _blocks(centroids: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, centers) in the order of the buckets, at most BLOCK_BYTES at a time."""
    names, rows, size = [], [], 0
    for r in centroids.select("bucket", "center").orderBy("bucket").toLocalIterator():
        names.append(r.bucket), rows.append(np.array(r.center, np.float64))
        size += rows[-1].nbytes
        if size >= BLOCK_BYTES:
            yield np.array(names, np.int32), np.stack(rows)
            names, rows, size = [], [], 0
    if names:
        yield np.array(names, np.int32), np.stack(rows)


def _nearest(x: np.ndarray, names: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and inner product of the best centroid of each row; the first of equal ones."""
    bucket, sim = np.empty(len(x), np.int32), np.empty(len(x))
    tile = max(1, min(TILE, (64 << 20) // (8 * len(names))))
    for a in range(0, len(x), tile):
        s = x[a : a + tile] @ centers.T
        best = s.argmax(1)
        bucket[a : a + tile], sim[a : a + tile] = names[best], s[np.arange(len(best)), best]
    return bucket, sim


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points (id, vec), centroids (bucket, center) -> id, vec, bucket, sim; ties go to the smallest bucket."""
    points = points.select("id", "vec")
    out, schema = None, T.StructType([*points.schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("sim", T.DoubleType())])
    for block in _blocks(centroids):
        shared = points.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bucket, sim = _nearest(_matrix(batch.column(1)), *shared.value)
                if batch.num_columns == 4:  # an earlier block's best stays unless this one's is better
                    old = batch.column(3).to_numpy()
                    bucket, sim = np.where(sim > old, bucket, batch.column(2).to_numpy()), np.maximum(sim, old)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bucket), pa.array(sim)], ["id", "vec", "bucket", "sim"])

        out = (points if out is None else out).mapInArrow(run, schema)
    return points.sparkSession.createDataFrame([], schema) if out is None else out


def _normalised(sums: DataFrame) -> DataFrame:
    """(bucket, pos, s, n) -> (bucket, center, n)."""
    whole = sums.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("v"), F.max("n").alias("n"))
    whole = whole.select("bucket", F.transform("v", lambda p: p["s"]).alias("v"), "n")
    size = norm("v")
    return whole.select("bucket", F.transform("v", lambda x: F.when(size > 0, x / size).otherwise(x)).alias("center"), "n")


def update(assigned: DataFrame) -> DataFrame:
    """assigned (bucket, vec) -> (bucket, center, n): normalised sums of the members, summed within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            names, inverse = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            x = _matrix(batch.column(1))
            order = np.argsort(inverse, kind="stable")
            starts = np.searchsorted(inverse[order], np.arange(len(names)))
            for name, s, n in zip(names.tolist(), np.add.reduceat(x[order], starts), np.bincount(inverse).tolist()):
                sums[name] = sums[name] + s if name in sums else s
                counts[name] = counts.get(name, 0) + n
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64())), pa.array([counts[k] for k in keys], pa.int64())], ["bucket", "sum", "n"])

    parts = assigned.select(F.col("bucket").cast("int").alias("bucket"), F.col("vec").cast("array<double>").alias("vec")).mapInArrow(run, "bucket int, sum array<double>, n long")
    sums = parts.select("bucket", "n", F.posexplode("sum").alias("pos", "x")).groupBy("bucket", "pos").agg(F.sum("x").alias("s"), F.sum("n").alias("n"))
    return _normalised(sums)


def training_sample(tokens: DataFrame, seed: int = 42) -> DataFrame:
    """Of each chunk the ceil(sqrt(n)) tokens with the smallest hash. tokens (chunk_id, token_offset, vec)."""
    order = W.partitionBy("chunk_id").orderBy(F.xxhash64(F.lit(seed), "chunk_id", "token_offset"), "token_offset")
    n = F.count("*").over(W.partitionBy("chunk_id"))
    return tokens.withColumn("place", F.row_number().over(order)).withColumn("of", n).where(F.col("place") <= F.ceil(F.sqrt("of"))).drop("place", "of")


def fit(points: DataFrame, k: int, *, iterations: int = 5, seed: int = 42) -> DataFrame:
    """(bucket, center) from points (id, vec). Starts from k points by hash order; an empty cluster takes the next unused point."""
    spark = points.sparkSession
    points = points.select("id", F.col("vec").cast("array<double>").alias("vec"))
    spare = [list(r.vec) for r in points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(2 * k).collect()]  # twice the centroids
    centers = spare[:k]
    used = len(centers)
    frame = lambda: spark.createDataFrame(list(enumerate(centers)), "bucket int, center array<double>")
    for _ in range(iterations):
        new = {r.bucket: list(r.center) for r in update(assign(points, frame())).collect()}
        for i in range(len(centers)):
            if i in new:
                centers[i] = new[i]
            elif used < len(spare):
                centers[i] = spare[used]
                used += 1
    return frame()
