"""Retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _gain(grade: str, place: str):
    return (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(place) + 1.0)


def ndcg(hits: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """hits (query_id, uuid, score), judged (query_id, uuid, grade) -> (query_id, ndcg) of every judged query; 0 without a relevant document."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("uuid"))
    top = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    dcg = top.join(judged, ["query_id", "uuid"]).groupBy("query_id").agg(F.sum(_gain("grade", "place")).alias("dcg"))
    ideal = W.partitionBy("query_id").orderBy(F.desc("grade"), F.asc("uuid"))
    most = judged.withColumn("place", F.row_number().over(ideal)).where(F.col("place") <= k).groupBy("query_id").agg(F.sum(_gain("grade", "place")).alias("idcg"))
    return most.join(dcg, "query_id", "left").select("query_id", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def precision(hits: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """(query_id, precision): share of the first k places that hold a document of positive grade."""
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("uuid"))
    top = hits.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    good = top.join(judged.where("grade > 0"), ["query_id", "uuid"], "left_semi").groupBy("query_id").agg(F.count("*").alias("n"))
    return top.select("query_id").distinct().join(good, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(k)).alias("precision"))
