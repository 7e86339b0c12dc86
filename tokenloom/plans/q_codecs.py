"""Queries over binary codecs, streams, tokenizer and sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import codecs as C
from ..functions.vectors import encode_levels
from ..operators import metrics, ranking, textsearch
from ..operators.filters import MetadataEquals
from ..operators.tokenizer import Unigram, tokenise
from ..sources.scratch import scratch_path
from ..streaming.ingest import matching
from .inputs import TOKENS, documents, table, tokens
from .q_scalar import _LEVEL

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {TOKENS} SELECT token, array_to_string(list_transform(vec, lambda x: substr('0123456789ABCDEF', CAST({_LEVEL} AS INTEGER) + 1, 1)), '') AS packed FROM tokens")
def nibble_pack(spark, sf_dir):
    """Residual levels as packed bytes, in hexadecimal; unpacked and packed again on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [C.pack_nibbles(C.unpack_nibbles(C.pack_nibbles(np.array(x)))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["token", "data"])

    return tokens(spark, sf_dir).select("token", encode_levels("vec").alias("levels")).mapInArrow(run, "token long, data binary").select("token", F.hex("data").alias("packed"))


@query("SELECT conv_id, turn FROM conversations")
def pairs_round_trip(spark, sf_dir):
    """Posting pairs through delta coding and LZ4 blocks and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = C.decode_pairs(C.encode_pairs(np.stack([c.to_numpy() for c in batch.columns], 1)))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].astype(np.int64)) for i in (0, 1)], ["conv_id", "turn"])

    sorted_ = table(spark, sf_dir, "conversations").select("conv_id", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    return sorted_.mapInArrow(run, "conv_id long, turn long")


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND NOT source = 'src3'")
def stream_filter(spark, sf_dir):
    """A stream of documents, filtered without state and written out; all files that are there now."""
    d = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(d.schema).parquet(f"{sf_dir}/documents.parque[t]")
    stream = stream.withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    out, notes = scratch_path(spark, "stream"), scratch_path(spark, "stream-notes")
    wanted = matching(stream, MetadataEquals("lang", "de") & ~MetadataEquals("source", "src3")).select("doc_id", "source")
    wanted.writeStream.format("parquet").option("path", out).option("checkpointLocation", notes).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, source string").parquet(out)


@query("""WITH t AS (SELECT item_id, i AS pos, lower(text)[i] AS c FROM benchmark, unnest(range(1, length(text) + 1)) AS r(i)),
k AS (SELECT *, CASE WHEN c BETWEEN 'a' AND 'z' THEN ascii(c) - 96 ELSE 0 END AS id FROM t),
n AS (SELECT *, lag(id, 1, 1) OVER (PARTITION BY item_id ORDER BY pos) AS last FROM k)
SELECT item_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS ids FROM n WHERE id > 0 OR last > 0 GROUP BY item_id""")
def unigram_tokenize(spark, sf_dir):
    """Unigram tokenizer with a piece per letter: everything else is unknown, and neighbouring unknowns fuse."""
    pieces = [("<unk>", 0.0), *((chr(96 + i), -1.0) for i in range(1, 27))]
    t = Unigram(pieces, unk=0, prepend=False, normalizers=[])
    joined = table(spark, sf_dir, "benchmark").select("item_id", F.translate(F.lower("text"), " ", "_").alias("text"))
    return tokenise(joined, t, id="item_id", text="text").select("item_id", F.array_join("ids", ",").alias("ids"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text END IS NULL AS lost, coalesce(length(CASE WHEN doc_id % 2 = 0 THEN text END), 0) AS n FROM documents")
def migrate_schema(spark, sf_dir):
    """Files of an older schema read with a newer one: the column they lack is null."""
    d = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "migrate")
    d.where("doc_id % 2 = 0").select("doc_id", F.col("text").alias("title")).write.parquet(path)
    d.where("doc_id % 2 != 0").select("doc_id").write.mode("append").parquet(path)
    new = spark.read.schema("doc_id long, title string").parquet(path)
    return new.select("doc_id", F.col("title").isNull().alias("lost"), F.coalesce(F.char_length("title"), F.lit(0)).cast("long").alias("n"))


@query()
def floyd_sample(spark, sf_dir):
    """Distinct rows drawn by SplitMix64 and Floyd's method: a stated number of ranks, joined to the table."""
    t = tokens(spark, sf_dir).select("token")
    ranks = C.SplitMix64(42).sample(t.count(), 25)
    return t.join(F.broadcast(spark.createDataFrame([(r,) for r in ranks], "token long")), "token")


@query()
def macro_ndcg(spark, sf_dir):
    """Full-text search judged by quality labels, one query for each of a few words."""
    d = documents(spark, sf_dir)
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("uuid"), F.col("quality").alias("grade"))
    hits, grades = None, None
    for q in ("the", "der", "que"):
        h = ranking.top_k(textsearch.bm25(d, q), 10).withColumn("query_id", F.lit(q))
        g = judged.withColumn("query_id", F.lit(q))
        hits, grades = (h, g) if hits is None else (hits.unionByName(h), grades.unionByName(g))
    return metrics.ndcg(hits, grades).agg(F.avg("ndcg").alias("ndcg"))
