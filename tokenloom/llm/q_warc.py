"""Query and SQL of the WARC writer and reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import scratch_path, texts
from .warc import read_archives, write_archives


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    archives = write_archives(texts(spark, sf_dir, "pages"), path)
    return read_archives(archives, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# DuckDB has SHA-1 in hexadecimal only: base32 takes five bits at a time.
OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
q AS (SELECT page_id, octet_length(b) AS payload_bytes, h, top FROM p JOIN m USING (h)),
bits AS (SELECT DISTINCT h, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', h[i]) - 1), 4, '0')), lambda a, b: a || b) AS s FROM q),
d AS (SELECT h, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + list_sum(list_transform(range(1, 6), lambda j: CAST(s[5 * i + j] AS INTEGER) * CAST(2 ** (5 - j) AS INTEGER)))::INTEGER, 1)), lambda a, b: a || b) AS digest FROM bits)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN coalesce(page_id = top, top IS NULL) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN coalesce(page_id = top, top IS NULL) THEN NULL ELSE top END AS refers_to
FROM q JOIN d USING (h)
"""
