"""Query of embedding near-dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .crosspolytope import link_vectors


def op3_crosspolytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


# Brute force over all pairs; the components by recursion over the links.
OP3_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
       AND list_dot_product(v, v) > 0),
link AS (SELECT a.rid AS x, a.vec_id AS xi, b.rid AS y, b.vec_id AS yi FROM ok a JOIN ok b ON a.rid <> b.rid AND len(a.v) = len(b.v)
         WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
reach AS (SELECT rid, vec_id AS c FROM ok UNION SELECT link.y, reach.c FROM reach JOIN link ON link.x = reach.rid),
comp AS (SELECT rid, min(c) AS c FROM reach GROUP BY rid),
n AS (SELECT x AS rid, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(vec_id = coalesce(c, vec_id), true) AS kept
FROM e LEFT JOIN n USING (rid) LEFT JOIN comp USING (rid)
"""
