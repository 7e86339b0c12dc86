"""How the driver's tables stand for the library's, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, terms
from ..sources.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(text: Column) -> Column:
    """The first three terms; reads no further than those."""
    term, gap = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
    start = F.regexp_extract(F.lower(text), rf"^(?:{gap})?({term}(?:{gap}{term}){{0,2}})", 1)
    return F.regexp_replace(start, gap, " ")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uuid, body, title (the first three terms), hash, metadata (lang, source)."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").cast("string").alias("uuid"), F.col("text").alias("body"), title_of(F.col("text")).alias("title"),
        content_hash("text").alias("hash"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
DOCS = rf"""docs AS (SELECT CAST(doc_id AS VARCHAR) AS uuid, text AS body, array_to_string({_TERMS.format("text")}[1:3], ' ') AS title,
  sha256(text) AS hash, lang, source FROM documents)"""


def sql_terms(column: str) -> str:
    return _TERMS.format(column)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk per distinct text: id (the smallest document), hash, model, token_count (terms)."""
    d = table(spark, sf_dir, "documents").groupBy(content_hash("text").alias("hash")).agg(F.min("doc_id").alias("id"), F.max(F.size(terms("text"))).alias("token_count"))
    return d.select("id", "hash", F.lit("terms").alias("model"), "token_count")


CHUNKS = f"""chunks AS (SELECT min(doc_id) AS id, sha256(text) AS hash, 'terms' AS model, max(len({sql_terms("text")})) AS token_count FROM documents GROUP BY 2)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors: doc is the label, token the vector's id."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc"), F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))


TOKENS = "tokens AS (SELECT label AS doc, vec_id AS token, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"


def query(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    t = tokens(spark, sf_dir).where(F.col("token") < n)
    return t.select(F.col("token").alias("q"), F.col("vec").alias("qvec"))


def sql_query(n: int = 4) -> str:
    return f"query AS (SELECT token AS q, vec AS qvec FROM tokens WHERE token < {n})"


#: A small index with fixed centres: two generations by parity, 16 centres each.
N_CENTERS = 16


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(centroids, postings) of the token vectors."""
    from ..operators.kmeans import assign

    t = tokens(spark, sf_dir)
    centers = t.where(F.col("token") < N_CENTERS).select(F.col("token").cast("int").alias("bucket"), F.col("vec").alias("center"))
    given = assign(t.select(F.struct("doc", "token").alias("id"), "vec"), centers).select((F.col("id.token") % 2).alias("gen"), "bucket", "id.doc", "id.token", "vec")
    counts = given.groupBy("gen", "bucket").agg(F.count("*").alias("n"))
    gens = spark.range(2).select(F.col("id").alias("gen"))
    centroids = centers.crossJoin(gens).join(counts, ["gen", "bucket"], "left").select("gen", "bucket", "center", F.coalesce("n", F.lit(0)).alias("n"))
    return centroids, given


INDEX = f"""centers AS (SELECT CAST(token AS INTEGER) AS bucket, vec AS center FROM tokens WHERE token < {N_CENTERS}),
postings AS (SELECT token % 2 AS gen, bucket, doc, token, vec FROM (
  SELECT t.*, bucket, row_number() OVER (PARTITION BY doc, token ORDER BY list_dot_product(vec, center) DESC, bucket) AS r FROM tokens t, centers) WHERE r = 1),
centroids AS (SELECT g.gen, c.bucket, c.center, coalesce(p.n, 0) AS n FROM centers c CROSS JOIN (SELECT unnest([0, 1]) AS gen) g
  LEFT JOIN (SELECT gen, bucket, count(*) AS n FROM postings GROUP BY 1, 2) p ON p.gen = g.gen AND p.bucket = c.bucket)"""
