"""Query and SQL of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .decontaminate import scan


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text")
    marked, s = scan(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.col(f"{s}.hits"), F.lit(0).cast("long"), lambda acc, h: acc + h["end"] - h["start"])
    return marked.select(
        "doc_id",
        F.col(f"{s}.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(f"{s}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(f"{s}.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
        FROM iw, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
dg AS (SELECT rid, i, size, array_to_string(w[i:i + size - 1], ' ') AS gram
       FROM dw, sizes, unnest(range(1, len(w) - size + 2)) AS r(i) WHERE len(w) >= size),
hit AS (SELECT rid, i, dg.size, item FROM dg JOIN win USING (size, gram)),
n AS (SELECT rid, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + size)) AS r(j) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (rid) LEFT JOIN it USING (rid)
"""
