"""Plans are what they are meant to be: pruned scans, limits before shuffles, no Python where SQL does."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import maintain, ranking
from tokenloom.plans import catalog


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_one_node(spark):
    hits = spark.range(100).select(F.col("id").cast("string").alias("uuid"), F.rand(1).alias("score"))
    assert "TakeOrderedAndProject" in plan(ranking.top_k(hits, 5))


def test_top_k_per_query_limits_before_the_shuffle(spark):
    hits = spark.range(100).select((F.col("id") % 5).alias("query_id"), F.col("id").cast("string").alias("uuid"), F.rand(1).alias("score"))
    text = plan(ranking.top_k_per_query(hits, 3))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


@pytest.mark.parametrize(("name", "columns"), [("all_uuids", "doc_id"), ("filter_date_range", "event_id,ts"), ("cluster_counts", "embedding,label,vec_id")])
def test_scans_read_needed_columns_only(spark, sf_dir, name, columns):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    for part in text.split("ReadSchema: struct<")[1:]:
        read = {x.split(":")[0] for x in part.split(">\n")[0].split(",") if ":" in x}
        assert read <= set(columns.split(",")), read


def test_date_filter_is_pushed(spark, sf_dir):
    text = plan(catalog.QUERIES["filter_date_range"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - {"fold_accents", "hash_embedder", "nibble_pack", "pairs_round_trip", "unigram_tokenize", "stream_filter"}))
def test_python_only_where_meant(spark, sf_dir, name):
    text = plan(catalog.QUERIES[name](spark, sf_dir))
    if "InArrow" in text or "Python" in text:
        assert name.startswith(("kmeans", "maxsim", "cluster", "bucket", "centroid", "missing", "chunk_ranges", "rrf"))


def test_deletes_are_anti_joins(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("uuid"))
    assert "LeftAnti" in plan(maintain.delete(docs, docs.limit(3)))
