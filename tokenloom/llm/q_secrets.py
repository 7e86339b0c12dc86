"""Query of secret scanning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import texts
from .secrets import BASE_RULES, find_secrets


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, s = find_secrets(texts(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter(s, lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter(s, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col(s)).alias("spans"),
    )
