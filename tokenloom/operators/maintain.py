"""Documents and chunks: upserts, deletes, deduplication, orphans, vacuuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert(docs: DataFrame, new: DataFrame, *, order: str | None = None) -> DataFrame:
    """docs with the rows of new in place of those with the same uuid; of several in new the last by `order` wins."""
    if order:
        w = W.partitionBy("uuid").orderBy(F.desc(order))
        new = new.withColumn("place_", F.row_number().over(w)).where("place_ = 1").drop("place_")
    return docs.join(new.select("uuid"), "uuid", "left_anti").unionByName(new.select(docs.columns))


def delete(docs: DataFrame, uuids: DataFrame) -> DataFrame:
    """docs without the given uuids; their chunks stay until a vacuum."""
    return docs.join(uuids.select("uuid"), "uuid", "left_anti")


def insert_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """chunks (id, hash, model, token_count) with new ones (hash, model, token_count) whose (hash, model) is not there yet.

    New ids continue from the largest, in the order of the hashes. The new ones
    are sorted by ranges; each range's place is its rank within the range and the
    number of those before, one row a range, so no task numbers all of them.
    """
    fresh = new.groupBy("hash", "model").agg(F.max("token_count").alias("token_count")).join(chunks.select("hash", "model"), ["hash", "model"], "left_anti")
    first = chunks.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    # A range is the first four digits of the hash: 65,536 at most, whatever the number of chunks.
    ranged = fresh.withColumn("range_", F.substring("hash", 1, 4)).withColumn("place", F.row_number().over(W.partitionBy("range_").orderBy("hash", "model")))
    sizes = fresh.groupBy(F.substring("hash", 1, 4).alias("range_")).agg(F.count("*").alias("n"))
    before = sizes.select("range_", (F.sum("n").over(W.orderBy("range_")) - F.col("n")).alias("before"))
    placed = ranged.join(before, "range_").crossJoin(F.broadcast(first))
    return chunks.unionByName(placed.select((F.col("last") + F.col("before") + F.col("place")).alias("id"), "hash", "model", "token_count"))


def dedup_plan(new: DataFrame, chunks: DataFrame, refs: DataFrame, pending: DataFrame) -> DataFrame:
    """new (hash, token_count) -> what to do with each: 'pending' (buffered already), 'indexed' (complete), 'rebuild' (orphaned in part) or 'new'."""
    known = new.dropDuplicates(["hash"]).join(chunks.select("hash", F.col("id").alias("chunk_id")), "hash", "left").join(refs, "chunk_id", "left").join(pending.select("chunk_id", F.lit(True).alias("waits")), "chunk_id", "left")
    action = F.when(F.col("chunk_id").isNull(), "new").when(F.col("waits"), "pending").when(F.coalesce("n_refs", F.lit(0)) >= F.col("token_count"), "indexed").otherwise("rebuild")
    return known.select("hash", "chunk_id", action.alias("action"))


def ref_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("chunk_id").agg(F.count("*").alias("n_refs"))


def orphaned(chunks: DataFrame, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with fewer tokens in the index than expected, and the documents that own them."""
    owners = docs.groupBy("hash").agg(F.array_sort(F.collect_list("uuid")).alias("owners"))
    counted = chunks.join(ref_counts(postings), chunks["id"] == F.col("chunk_id"), "left")
    short = counted.withColumn("n_refs", F.coalesce("n_refs", F.lit(0))).where(F.col("n_refs") < F.col("token_count"))
    return short.join(owners, "hash", "left").select("id", "hash", "model", "token_count", "n_refs", F.coalesce("owners", F.array().cast("array<string>")).alias("owners"))


def abandoned(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks that no document owns."""
    return chunks.join(docs.select("hash"), "hash", "left_anti")


def vacuum_batch(chunks: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """The first abandoned chunks by id, and how many remain after them."""
    gone = abandoned(chunks, docs)
    total = gone.agg(F.count("*").alias("total"))
    return gone.orderBy("id").limit(most).crossJoin(F.broadcast(total)).select("id", "hash", F.greatest(F.col("total") - most, F.lit(0)).alias("remaining"))


def vacuum(postings: DataFrame, batch: DataFrame) -> DataFrame:
    """Postings without those of the batch's chunks (chunk_id = id)."""
    return postings.join(batch.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
