"""MaxSim scoring of token vectors, exact and pruned by centroids.

Inner products are blocked matrix products in Arrow batches. Each batch keeps the
best one per document and query token only, so what is shuffled is as long as
documents times query tokens, not as tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.vectors import dot

#: A query is a stated, small set: up to this many tokens, which are broadcast. Rows of tokens in one product.
QUERY_ROWS, TILE = 10_000, 4096


def distinct_tokens(query: DataFrame) -> DataFrame:
    """query (q, qvec) with equal vectors collapsed: the first q of each and its multiplicity."""
    return query.groupBy("qvec").agg(F.min("q").alias("q"), F.count("*").alias("times")).select("q", "qvec", "times")


def _checked(query: DataFrame) -> list:
    rows = query.limit(QUERY_ROWS + 1).collect()
    if len(rows) > QUERY_ROWS:
        raise ValueError(f"a query of over {QUERY_ROWS} tokens is to be scored in parts")
    return rows


def _paired(query: DataFrame, others: DataFrame) -> DataFrame:
    """Every query token with every row of others, by expression: for few rows such as centroids."""
    _checked(query)
    return others.crossJoin(F.broadcast(query))


def best_products(query: DataFrame, tokens: DataFrame) -> DataFrame:
    """query (q, qvec), tokens (doc, vec) -> (doc, q, best): the largest inner product of each document with each query token."""
    rows = _checked(query.select("q", "qvec"))
    names = [r.q for r in rows]
    matrix = np.array([r.qvec for r in rows], np.float64)
    shared = tokens.sparkSession.sparkContext.broadcast(matrix)
    doc = tokens.schema["doc"]
    schema = T.StructType([T.StructField("doc", doc.dataType), T.StructField("at", T.IntegerType()), T.StructField("best", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            place = coded.indices.to_numpy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            best = np.full((len(coded.dictionary), len(q)), -np.inf)
            order = np.argsort(place, kind="stable")
            tile = max(1, min(TILE, (64 << 20) // (8 * len(q))))
            for a in range(0, len(x), tile):
                part = order[a : a + tile]
                own = place[part]
                starts = np.flatnonzero(np.append(True, np.diff(own) != 0))
                top = np.maximum.reduceat(x[part] @ q.T, starts, axis=0)
                best[own[starts]] = np.maximum(best[own[starts]], top)
            n = len(coded.dictionary)
            docs = coded.dictionary.take(pa.array(np.repeat(np.arange(n), len(q))))
            yield pa.RecordBatch.from_arrays([docs, pa.array(np.tile(np.arange(len(q), dtype=np.int32), n)), pa.array(best.ravel())], ["doc", "at", "best"])

    found = tokens.select("doc", "vec").mapInArrow(run, schema).groupBy("doc", "at").agg(F.max("best").alias("best"))
    kind = query.schema["q"].dataType
    named = tokens.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], T.StructType([T.StructField("at", T.IntegerType()), T.StructField("q", kind)]))
    return found.join(F.broadcast(named), "at").select("doc", "q", "best")


def exact(query: DataFrame, tokens: DataFrame) -> DataFrame:
    """query (q, qvec), tokens (doc, vec) -> (doc, score): mean over query tokens of the best inner product."""
    q = distinct_tokens(query)
    n = query.count()
    best = best_products(q, tokens).join(F.broadcast(q.select("q", "times")), "q")
    return best.groupBy("doc").agg((F.sum(F.col("best") * F.col("times")) / n).alias("score"))


def passages(query: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """exact() for every doc of docs, 0 for one without tokens."""
    return docs.select("doc").distinct().join(exact(query, tokens), "doc", "left").select("doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def select_centroids(query: DataFrame, centroids: DataFrame, *, k: int = 32, token_budget: int = 40_000) -> DataFrame:
    """Buckets to search: per generation and query token the nearest centroids, at most k, until their tokens reach the budget.

    centroids (gen, bucket, center, n). Returns gen, q, bucket, sim, n, crossed:
    the bucket that reaches the budget is still taken; crossed says that one did.
    """
    sims = _paired(query.select("q", "qvec"), centroids).select("gen", "q", "bucket", "n", dot("qvec", "center").alias("sim"))
    order = W.partitionBy("gen", "q").orderBy(F.desc("sim"), F.asc("bucket"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = sims.withColumn("place", F.row_number().over(order)).withColumn("before", before).where((F.col("place") <= k) & (F.col("before") < token_budget))
    return taken.withColumn("crossed", F.sum("n").over(W.partitionBy("gen", "q")) >= token_budget).select("gen", "q", "bucket", "sim", "n", "place", "crossed")


def missing_baseline(selected: DataFrame) -> DataFrame:
    """(q, missing): what a document without evidence may still score, from generations searched within their budget."""
    per = selected.where(~F.col("crossed")).groupBy("gen", "q").agg(F.min("sim").alias("last"))
    return per.groupBy("q").agg(F.max("last").alias("missing"))


def pruned(query: DataFrame, centroids: DataFrame, postings: DataFrame, *, k: int = 32, token_budget: int = 40_000, threshold: float = 0.0) -> DataFrame:
    """query (q, qvec), centroids, postings (gen, bucket, doc, vec) -> (doc, score).

    Only documents with a token in a selected bucket can be hits. A query token
    without evidence in a document scores its baseline; with neither, the
    document is undefined and dropped. Scores below threshold are dropped too.
    """
    q = distinct_tokens(query)
    n = query.count()
    selected = select_centroids(q, centroids, k=k, token_budget=token_budget)
    buckets = selected.select("gen", "bucket").distinct()
    best = best_products(q, postings.join(buckets, ["gen", "bucket"], "left_semi"))
    grid = best.select("doc").distinct().crossJoin(F.broadcast(q.select("q", "times")))
    full = grid.join(best, ["doc", "q"], "left").join(F.broadcast(missing_baseline(selected)), "q", "left")
    value = F.greatest("best", "missing")  # skips nulls
    scored = full.groupBy("doc").agg((F.sum(value * F.col("times")) / n).alias("score"), F.count_if(value.isNull()).alias("undefined"))
    return scored.where((F.col("undefined") == 0) & (F.col("score") >= threshold)).select("doc", "score")
