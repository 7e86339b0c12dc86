"""Queries over documents and chunks: scans, filters, lookups, upserts, deduplication, orphans, vacuum."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import string_metadata
from ..operators import maintain
from ..operators.filters import DateRange, MetadataEquals, UuidIn, apply
from .inputs import CHUNKS, DOCS, chunks, documents, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {DOCS} SELECT uuid, title, lang FROM docs WHERE (lang = 'en' OR source = 'src1') AND NOT (source = 'src2') AND uuid NOT IN ('3', '5')")
def doc_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = (MetadataEquals("lang", "en") | MetadataEquals("source", "src1")) & ~MetadataEquals("source", "src2") & ~UuidIn(("3", "5"))
    return apply(documents(spark, sf_dir), wanted).select("uuid", "title", F.col("metadata")["lang"].alias("lang"))


@query("SELECT CAST(doc_id AS VARCHAR) AS uuid, text AS body FROM documents WHERE doc_id = 42")
def doc_point_lookup(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id = 42").select(F.col("doc_id").cast("string").alias("uuid"), F.col("text").alias("body"))


@query(f"WITH {DOCS}, few AS (SELECT DISTINCT hash FROM docs WHERE CAST(uuid AS BIGINT) % 20 = 0) SELECT uuid, docs.hash FROM docs JOIN few USING (hash)")
def docs_by_chunk_hash(spark, sf_dir):
    d = documents(spark, sf_dir).select("uuid", "hash")
    return d.join(d.where(F.col("uuid").cast("long") % 20 == 0).select("hash").distinct(), "hash").select("uuid", "hash")


@query(f"WITH {DOCS} SELECT count(*) AS n_documents, count(DISTINCT uuid) AS n_uuids, count(DISTINCT hash) AS n_hashes FROM docs")
def doc_counts(spark, sf_dir):
    return documents(spark, sf_dir).agg(F.count("*").alias("n_documents"), F.count_distinct("uuid").alias("n_uuids"), F.count_distinct("hash").alias("n_hashes"))


@query("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS uuid FROM documents")
def all_uuids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("uuid")).distinct()


@query("SELECT DISTINCT sha256(text) AS hash FROM documents")
def distinct_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select("hash").distinct()


@query(f"WITH {CHUNKS} SELECT id, hash, model, CAST(token_count AS BIGINT) AS token_count FROM chunks")
def chunk_scan(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", "hash", "model", F.col("token_count").cast("long").alias("token_count")).orderBy("id")


@query(f"WITH {CHUNKS} SELECT c.id, c.hash FROM chunks c JOIN documents d ON sha256(d.text) = c.hash WHERE d.doc_id = 7")
def chunk_lookup(spark, sf_dir):
    one = documents(spark, sf_dir).where("uuid = '7'").select("hash")
    return chunks(spark, sf_dir).join(one, "hash").select("id", "hash")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'")
def filter_date_range(spark, sf_dir):
    wanted = DateRange(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20, 12))
    return apply(table(spark, sf_dir, "events").withColumnRenamed("ts", "date"), wanted).select("event_id")


@query("""SELECT event_id, json_type(props, '$.k') = 'VARCHAR' AND json_extract_string(props, '$.k') = '5' AS equals, NOT (coalesce(json_type(props, '$.k') = 'VARCHAR', false) AND json_extract_string(props, '$.k') = '5') AS differs FROM events""")
def filter_metadata_numeric(spark, sf_dir):
    """A number is never equal to its text, and the negation is true where the key is no text."""
    e = table(spark, sf_dir, "events").withColumn("metadata", string_metadata("props"))
    leaf = MetadataEquals("k", "5")
    return e.select("event_id", leaf.truth().alias("equals"), (~leaf).truth().alias("differs"))


@query("SELECT doc_id FROM documents WHERE NOT coalesce(CASE WHEN doc_id % 3 = 0 THEN source END = 'src0', false)")
def filter_not_metadata(spark, sf_dir):
    """Documents without the key match a negated test for it."""
    d = table(spark, sf_dir, "documents").withColumn("metadata", F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit("source"), "source")).otherwise(F.create_map().cast("map<string,string>")))
    return apply(d, ~MetadataEquals("source", "src0")).select("doc_id")


@query("""WITH new AS (SELECT doc_id AS id, 'new ' || lang AS body FROM documents WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id + 100000000, 'added' FROM documents WHERE doc_id < 5)
SELECT CAST(id AS VARCHAR) AS uuid, body FROM new UNION ALL SELECT CAST(doc_id AS VARCHAR), text FROM documents WHERE doc_id NOT IN (SELECT id FROM new)""")
def upsert_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    new = d.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("uuid"), F.concat(F.lit("new "), "lang").alias("body"))
    more = d.where("doc_id < 5").select((F.col("doc_id") + 100_000_000).cast("string").alias("uuid"), F.lit("added").alias("body"))
    return maintain.upsert(d.select(F.col("doc_id").cast("string").alias("uuid"), F.col("text").alias("body")), new.unionByName(more))


@query("SELECT CAST(doc_id AS VARCHAR) AS uuid FROM documents WHERE doc_id % 4 <> 1")
def delete_documents(spark, sf_dir):
    d = documents(spark, sf_dir).select("uuid")
    return maintain.delete(d, d.where(F.col("uuid").cast("long") % 4 == 1))


@query(f"""WITH {CHUNKS}, old AS (SELECT * FROM chunks WHERE id % 2 = 0),
fresh AS (SELECT hash, token_count, (SELECT coalesce(max(id), 0) FROM old) + row_number() OVER (ORDER BY hash) AS id FROM chunks WHERE hash NOT IN (SELECT hash FROM old))
SELECT id, hash, CAST(token_count AS BIGINT) AS token_count FROM old UNION ALL SELECT id, hash, token_count FROM fresh""")
def insert_chunks_if_absent(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return maintain.insert_chunks(c.where("id % 2 = 0"), c.drop("id")).select("id", "hash", F.col("token_count").cast("long").alias("token_count"))


_REFS = "refs AS (SELECT id AS chunk_id, token_count - CASE WHEN id % 5 = 0 THEN least(token_count, 3) ELSE 0 END AS n_refs FROM chunks WHERE id % 11 <> 0)"


def _postings(spark, sf_dir):
    """One row per indexed token: every fifth chunk lacks up to three tokens, every eleventh all."""
    c = chunks(spark, sf_dir).where("id % 11 != 0")
    n = F.col("token_count") - F.when(F.col("id") % 5 == 0, F.least("token_count", F.lit(3))).otherwise(0)
    return c.where(n > 0).select(F.col("id").alias("chunk_id"), F.explode(F.sequence(F.lit(1), n)).alias("token_offset"))


@query(f"WITH {CHUNKS}, {_REFS} SELECT chunk_id, CAST(n_refs AS BIGINT) AS n_refs FROM refs WHERE n_refs > 0")
def ref_counts(spark, sf_dir):
    return maintain.ref_counts(_postings(spark, sf_dir))


@query(f"""WITH {CHUNKS}, {DOCS}, {_REFS}, own AS (SELECT hash, string_agg(uuid, ',' ORDER BY uuid) AS owners FROM docs WHERE CAST(uuid AS BIGINT) % 7 <> 0 GROUP BY hash)
SELECT id, CAST(token_count AS BIGINT) AS token_count, CAST(coalesce(n_refs, 0) AS BIGINT) AS n_refs, coalesce(owners, '') AS owners
FROM chunks LEFT JOIN refs ON chunk_id = id LEFT JOIN own USING (hash) WHERE coalesce(n_refs, 0) < token_count""")
def orphaned_chunks(spark, sf_dir):
    d = documents(spark, sf_dir).where(F.col("uuid").cast("long") % 7 != 0)
    o = maintain.orphaned(chunks(spark, sf_dir), _postings(spark, sf_dir), d)
    return o.select("id", F.col("token_count").cast("long").alias("token_count"), F.col("n_refs").cast("long").alias("n_refs"), F.array_join("owners", ",").alias("owners"))


@query(f"WITH {CHUNKS} SELECT id, hash FROM chunks WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id % 7 <> 0 AND sha256(d.text) = chunks.hash)")
def abandoned_chunks(spark, sf_dir):
    return maintain.abandoned(chunks(spark, sf_dir), documents(spark, sf_dir).where(F.col("uuid").cast("long") % 7 != 0)).select("id", "hash")


_BATCH = """gone AS (SELECT id, hash FROM chunks WHERE hash NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 7 <> 0)),
batch AS (SELECT id, hash, greatest((SELECT count(*) FROM gone) - 20, 0) AS remaining FROM gone ORDER BY id LIMIT 20)"""


@query(f"WITH {CHUNKS}, {_BATCH} SELECT id, hash, CAST(remaining AS BIGINT) AS remaining FROM batch")
def vacuum_batch(spark, sf_dir):
    return maintain.vacuum_batch(chunks(spark, sf_dir), documents(spark, sf_dir).where(F.col("uuid").cast("long") % 7 != 0), 20)


@query(f"WITH {CHUNKS}, {_REFS}, {_BATCH} SELECT chunk_id, CAST(n_refs AS BIGINT) AS n_left FROM refs WHERE n_refs > 0 AND chunk_id NOT IN (SELECT id FROM batch)")
def vacuum_postings(spark, sf_dir):
    batch = maintain.vacuum_batch(chunks(spark, sf_dir), documents(spark, sf_dir).where(F.col("uuid").cast("long") % 7 != 0), 20)
    return maintain.vacuum(_postings(spark, sf_dir), batch).groupBy("chunk_id").agg(F.count("*").alias("n_left"))


@query(f"""WITH {CHUNKS}, {_REFS}, new AS (SELECT hash, id, token_count FROM chunks)
SELECT n.hash, CASE WHEN n.id % 3 = 0 THEN 'new' WHEN n.id % 13 = 0 THEN 'pending' WHEN coalesce(r.n_refs, 0) >= n.token_count THEN 'indexed' ELSE 'rebuild' END AS action
FROM new n LEFT JOIN refs r ON r.chunk_id = n.id""")
def dedup_three_way(spark, sf_dir):
    c = chunks(spark, sf_dir)
    refs = maintain.ref_counts(_postings(spark, sf_dir))
    waiting = c.where("id % 13 = 0").select(F.col("id").alias("chunk_id"))
    return maintain.dedup_plan(c.select("hash", "token_count"), c.where("id % 3 != 0").select("id", "hash"), refs, waiting).select("hash", "action")


@query("SELECT doc_id, sha256(text) AS hash, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def join_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality = 1")
    return d.select("doc_id", F.sha2("text", 256).alias("hash"), "quality")
