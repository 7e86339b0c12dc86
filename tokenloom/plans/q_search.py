"""Queries of search: MaxSim, centroid selection, full text, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmeans, lsm, maxsim, metrics, ranking, textsearch
from .inputs import DOCS, INDEX, TOKENS, documents, index, query as query_tokens, sql_query, sql_terms, table, tokens

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TOKENS}, {sql_query()} SELECT CAST(doc AS BIGINT) AS doc, round(sum(best) / (SELECT count(*) FROM query), 6) AS score FROM (
SELECT doc, q, max(list_dot_product(qvec, vec)) AS best FROM query, tokens GROUP BY 1, 2) GROUP BY doc""")
def maxsim_exact(spark, sf_dir):
    scored = maxsim.exact(query_tokens(spark, sf_dir), tokens(spark, sf_dir))
    return scored.select(F.col("doc").cast("long").alias("doc"), F.round("score", 6).alias("score"))


@query(f"""WITH {TOKENS}, {sql_query()}, s AS (SELECT doc, sum(best) / (SELECT count(*) FROM query) AS score FROM (
SELECT doc, q, max(list_dot_product(qvec, vec)) AS best FROM query, (SELECT * FROM tokens WHERE token % 2 = 1 AND doc <> 3) GROUP BY 1, 2) GROUP BY doc)
SELECT CAST(d.doc AS BIGINT) AS doc, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT doc FROM tokens) d LEFT JOIN s USING (doc)""")
def maxsim_passages(spark, sf_dir):
    t = tokens(spark, sf_dir)
    scored = maxsim.passages(query_tokens(spark, sf_dir), t.where("token % 2 = 1 AND doc != 3"), t)
    return scored.select(F.col("doc").cast("long").alias("doc"), F.round("score", 6).alias("score"))


@query(f"""WITH {TOKENS}, twice AS (SELECT token AS q, vec AS qvec FROM tokens WHERE token < 6 UNION ALL SELECT token + 100, vec FROM tokens WHERE token IN (1, 4))
SELECT min(q) AS q, count(*) AS times FROM twice GROUP BY qvec""")
def query_token_dedup(spark, sf_dir):
    t = tokens(spark, sf_dir)
    twice = t.where("token < 6").select(F.col("token").alias("q"), F.col("vec").alias("qvec")).unionByName(t.where("token IN (1, 4)").select((F.col("token") + 100).alias("q"), F.col("vec").alias("qvec")))
    return maxsim.distinct_tokens(twice).select("q", "times")


_K, _BUDGET = 6, 40
_SELECT = f"""sims AS (SELECT gen, q, bucket, n, list_dot_product(qvec, center) AS sim FROM query, centroids),
placed AS (SELECT *, row_number() OVER w AS place, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sims WINDOW w AS (PARTITION BY gen, q ORDER BY sim DESC, bucket)),
selected AS (SELECT *, sum(n) OVER (PARTITION BY gen, q) >= {_BUDGET} AS crossed FROM placed WHERE place <= {_K} AND before < {_BUDGET})"""


@query(f"WITH {TOKENS}, {sql_query()}, {INDEX}, {_SELECT} SELECT CAST(gen AS BIGINT) AS gen, q, bucket, round(sim, 6) AS sim, CAST(n AS BIGINT) AS n, crossed FROM selected")
def centroid_select_budget(spark, sf_dir):
    centroids, _ = index(spark, sf_dir)
    s = maxsim.select_centroids(query_tokens(spark, sf_dir), centroids, k=_K, token_budget=_BUDGET)
    return s.select("gen", "q", "bucket", F.round("sim", 6).alias("sim"), "n", "crossed")


_MISSING = "missing AS (SELECT q, max(last) AS missing FROM (SELECT gen, q, min(sim) AS last FROM selected WHERE NOT crossed GROUP BY 1, 2) GROUP BY q)"


@query(f"WITH {TOKENS}, {sql_query()}, {INDEX}, {_SELECT.replace(f'before < {_BUDGET}', 'before < 300').replace(f'>= {_BUDGET}', '>= 300')}, {_MISSING} SELECT q, round(missing, 6) AS missing FROM missing")
def missing_baseline(spark, sf_dir):
    centroids, _ = index(spark, sf_dir)
    s = maxsim.select_centroids(query_tokens(spark, sf_dir), centroids, k=_K, token_budget=300)
    return maxsim.missing_baseline(s).select("q", F.round("missing", 6).alias("missing"))


@query(f"""WITH {TOKENS}, {sql_query()}, {INDEX}, {_SELECT}, {_MISSING},
best AS (SELECT doc, q, max(list_dot_product(qvec, vec)) AS best FROM query, postings p WHERE (p.gen, p.bucket) IN (SELECT (gen, bucket) FROM selected) GROUP BY 1, 2),
grid AS (SELECT d.doc, query.q FROM (SELECT DISTINCT doc FROM best) d, query),
v AS (SELECT g.doc, g.q, greatest(best, missing) AS v FROM grid g LEFT JOIN best b ON b.doc = g.doc AND b.q = g.q LEFT JOIN missing m ON m.q = g.q)
SELECT CAST(doc AS BIGINT) AS doc, round(sum(v) / count(*), 6) AS score FROM v GROUP BY doc HAVING count(v) = count(*) AND sum(v) / count(*) >= 0""")
def maxsim_pruned(spark, sf_dir):
    centroids, postings = index(spark, sf_dir)
    s = maxsim.pruned(query_tokens(spark, sf_dir), centroids, postings, k=_K, token_budget=_BUDGET)
    return s.select(F.col("doc").cast("long").alias("doc"), F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS}, {INDEX} SELECT gen, bucket, CAST(doc AS BIGINT) AS doc, token FROM postings WHERE gen = 1")
def bucket_scan(spark, sf_dir):
    _, p = index(spark, sf_dir)
    return p.where("gen = 1").select("gen", "bucket", F.col("doc").cast("long").alias("doc"), "token")


@query(f"WITH {TOKENS}, {INDEX} SELECT CAST(gen AS BIGINT) AS gen, bucket, CAST(n AS BIGINT) AS n FROM centroids")
def cluster_counts(spark, sf_dir):
    return index(spark, sf_dir)[0].select("gen", "bucket", "n")


@query(f"WITH {TOKENS}, {INDEX} SELECT gen, min(doc) AS min_chunk, max(doc) AS max_chunk, count(*) AS n_tokens FROM postings GROUP BY gen")
def chunk_ranges(spark, sf_dir):
    return lsm.chunk_ranges(index(spark, sf_dir)[1].withColumnRenamed("doc", "chunk_id"))


@query(f"WITH {TOKENS}, {INDEX} SELECT token, bucket, round(list_dot_product(vec, center), 6) AS sim FROM postings JOIN centers USING (bucket)")
def kmeans_assign(spark, sf_dir):
    t = tokens(spark, sf_dir)
    centers = t.where("token < 16").select(F.col("token").cast("int").alias("bucket"), F.col("vec").alias("center"))
    return kmeans.assign(t.select(F.col("token").alias("id"), "vec"), centers).select(F.col("id").alias("token"), "bucket", F.round("sim", 6).alias("sim"))


@query(f"""WITH {TOKENS}, {INDEX}, s AS (SELECT bucket, i, sum(vec[i]) AS s FROM postings, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2)
SELECT bucket, CAST(i - 1 AS BIGINT) AS pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY bucket)), 6) AS x FROM s""")
def kmeans_update(spark, sf_dir):
    t = tokens(spark, sf_dir)
    centers = t.where("token < 16").select(F.col("token").cast("int").alias("bucket"), F.col("vec").alias("center"))
    new = kmeans.update(kmeans.assign(t.select(F.col("token").alias("id"), "vec"), centers))
    return new.select("bucket", F.posexplode("center").alias("pos", "x")).select("bucket", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"WITH {TOKENS} SELECT CAST(doc AS BIGINT) AS doc, CAST(ceil(sqrt(count(*))) AS BIGINT) AS n FROM tokens GROUP BY doc")
def training_sample_sizes(spark, sf_dir):
    t = tokens(spark, sf_dir).select(F.col("doc").alias("chunk_id"), F.col("token").alias("token_offset"), "vec")
    return kmeans.training_sample(t).groupBy(F.col("chunk_id").cast("long").alias("doc")).agg(F.count("*").alias("n"))


def _bm25_sql(words: list[str], op: str, weight: float = 3.0) -> str:
    f = ", ".join(f"{weight} * len(list_filter(t, lambda x: x = '{w}')) + len(list_filter(b, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(words))
    stats = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(words)))
    part = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / avgdl))"
    return f"""WITH {DOCS}, cut AS (SELECT uuid, {sql_terms("title")} AS t, {sql_terms("body")} AS b FROM docs),
counted AS (SELECT uuid, CAST(len(t) + len(b) AS DOUBLE) AS size, {f} FROM cut), stats AS (SELECT count(*) AS n, avg(size) AS avgdl, {stats} FROM counted),
scored AS (SELECT uuid, {" + ".join(part(i) for i in range(len(words)))} AS score FROM counted, stats WHERE {f" {op} ".join(f"f{i} > 0" for i in range(len(words)))})"""


@query(_bm25_sql(["the", "with"], "AND") + " SELECT uuid, round(score, 6) AS score FROM scored")
def bm25_all(spark, sf_dir):
    return textsearch.bm25(documents(spark, sf_dir), "the with").select("uuid", F.round("score", 6).alias("score"))


@query(_bm25_sql(["que", "und", "with"], "OR") + " SELECT uuid, round(score, 6) AS score FROM scored")
def bm25_any(spark, sf_dir):
    return textsearch.bm25(documents(spark, sf_dir), "que und with", match="any").select("uuid", F.round("score", 6).alias("score"))


@query(f"""WITH {DOCS} SELECT uuid, round(score, 6) AS score FROM (SELECT uuid, (
len(list_filter(['the', 'que', 'the'], lambda w: list_contains({sql_terms("body")}, w))) + 3.0 * len(list_filter(['the', 'que', 'the'], lambda w: list_contains({sql_terms("title")}, w)))) / 3 AS score FROM docs) WHERE score > 0""")
def overlap_score(spark, sf_dir):
    return textsearch.overlap(documents(spark, sf_dir), "the que the").select("uuid", F.round("score", 6).alias("score"))


@query(_bm25_sql(["the", "with"], "AND") + " SELECT uuid, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 6) DESC, uuid) AS BIGINT) AS rank FROM scored ORDER BY round(score, 6) DESC, uuid LIMIT 25")
def fts_search(spark, sf_dir):
    hits = textsearch.bm25(documents(spark, sf_dir), "the with").select("uuid", F.round("score", 6).alias("score"))
    return ranking.ranked(ranking.top_k(hits, 25)).withColumn("rank", F.col("rank").cast("long"))


_VECTOR = f"""{TOKENS}, {sql_query()}, vec AS (SELECT CAST(doc AS VARCHAR) AS uuid, round(sum(best) / (SELECT count(*) FROM query), 6) AS score FROM (
SELECT token // 5 AS doc, q, max(list_dot_product(qvec, vec)) AS best FROM query, tokens GROUP BY 1, 2) GROUP BY doc)"""


@query(_bm25_sql(["the", "with"], "AND").rstrip() + f""", {_VECTOR},
v AS (SELECT uuid, score AS vector_score, row_number() OVER (ORDER BY score DESC, uuid) AS vector_rank FROM vec QUALIFY vector_rank <= 50),
f AS (SELECT uuid, round(score, 6) AS fts_score, row_number() OVER (ORDER BY round(score, 6) DESC, uuid) AS fts_rank FROM scored QUALIFY fts_rank <= 50)
SELECT uuid, round(coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + fts_rank), 0), 9) AS score, CAST(vector_rank AS BIGINT) AS vector_rank, vector_score, CAST(fts_rank AS BIGINT) AS fts_rank, fts_score
FROM v FULL JOIN f USING (uuid) ORDER BY coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + fts_rank), 0) DESC, uuid LIMIT 30""")
def rrf_hybrid(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("doc", F.floor(F.col("token") / 5).cast("string"))
    vector = maxsim.exact(query_tokens(spark, sf_dir), t).select(F.col("doc").alias("uuid"), F.round("score", 6).alias("score"))
    text = textsearch.bm25(documents(spark, sf_dir), "the with").select("uuid", F.round("score", 6).alias("score"))
    fused = ranking.fuse(vector, text, top=30)
    return fused.select("uuid", F.round("score", 9).alias("score"), F.col("vector_rank").cast("long").alias("vector_rank"), "vector_score", F.col("fts_rank").cast("long").alias("fts_rank"), "fts_score")


_PER_QUERY = f"""{TOKENS}, sims AS (SELECT a.token AS query_id, CAST(b.token AS VARCHAR) AS uuid, round(list_dot_product(a.vec, b.vec), 6) AS score FROM tokens a, tokens b WHERE a.token < 8 AND b.token <> a.token),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uuid) AS rank FROM sims)"""


def _per_query(spark, sf_dir):
    from ..functions.vectors import dot

    t = tokens(spark, sf_dir)
    q = t.where("token < 8").select(F.col("token").alias("query_id"), F.col("vec").alias("qvec"))
    return t.crossJoin(F.broadcast(q)).where("token != query_id").select("query_id", F.col("token").cast("string").alias("uuid"), F.round(dot("qvec", "vec"), 6).alias("score"))


@query(f"WITH {_PER_QUERY} SELECT query_id, uuid, score, rank FROM top WHERE rank <= 10")
def top_k_per_query(spark, sf_dir):
    return ranking.top_k_per_query(_per_query(spark, sf_dir), 10).withColumn("rank", F.col("rank").cast("long"))


_JUDGED = "judged AS (SELECT q.token AS query_id, CAST(t.token AS VARCHAR) AS uuid, CASE WHEN t.doc = q.doc THEN 1 + t.token % 2 ELSE 0 END AS grade FROM tokens t, tokens q WHERE q.token < 8 AND t.token <> q.token AND t.token % 3 <> 0)"


def _judged(spark, sf_dir):
    t = tokens(spark, sf_dir).select("doc", "token")
    q = t.where("token < 8").select(F.col("token").alias("query_id"), F.col("doc").alias("qdoc"))
    j = t.where("token % 3 != 0").crossJoin(F.broadcast(q)).where("token != query_id")
    return j.select("query_id", F.col("token").cast("string").alias("uuid"), F.when(F.col("doc") == F.col("qdoc"), 1 + F.col("token") % 2).otherwise(0).alias("grade"))


@query(f"""WITH {_PER_QUERY}, {_JUDGED},
dcg AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM top JOIN judged USING (query_id, uuid) WHERE rank <= 10 GROUP BY 1),
best AS (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, uuid) AS r FROM judged), idcg AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(r + 1)) AS idcg FROM best WHERE r <= 10 GROUP BY 1)
SELECT query_id, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg FROM idcg LEFT JOIN dcg USING (query_id)""")
def ndcg10(spark, sf_dir):
    return metrics.ndcg(_per_query(spark, sf_dir), _judged(spark, sf_dir)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"""WITH {_PER_QUERY}, {_JUDGED} SELECT query_id, round(count(*) FILTER (WHERE grade > 0) / 5.0, 6) AS precision FROM top LEFT JOIN judged USING (query_id, uuid) WHERE rank <= 5 GROUP BY 1""")
def precision5(spark, sf_dir):
    return metrics.precision(_per_query(spark, sf_dir), _judged(spark, sf_dir), 5).select("query_id", F.round("precision", 6).alias("precision"))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(avg(value), 6) AS mean FROM events")
def percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.avg("value"), 6).alias("mean"))


_GENS = "gens AS (SELECT CAST(l_suppkey % 7 AS BIGINT) AS gen, CAST(l_suppkey % 7 % 3 AS INTEGER) AS level, min(l_orderkey) AS min_chunk, max(l_orderkey) AS max_chunk, count(*) AS n_tokens, max(l_shipdate) AS created FROM lineitem GROUP BY 1, 2)"


def _gens(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7).cast("long").alias("gen"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("token_offset"), "l_shipdate")
    gens = li.groupBy("gen").agg(F.min("chunk_id").alias("min_chunk"), F.max("chunk_id").alias("max_chunk"), F.count("*").alias("n_tokens"), F.max("l_shipdate").alias("created"))
    return li, gens.withColumn("level", (F.col("gen") % 3).cast("int"))


@query(f"WITH {_GENS} SELECT CAST(level AS BIGINT) AS level, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) AS n_generations FROM gens GROUP BY 1")
def level_sums(spark, sf_dir):
    return lsm.level_sums(_gens(spark, sf_dir)[1]).withColumn("level", F.col("level").cast("long"))


@query(f"WITH {_GENS} SELECT gen FROM gens WHERE min_chunk <= 60 AND max_chunk >= 40")
def range_overlap(spark, sf_dir):
    return lsm.overlapping(_gens(spark, sf_dir)[1], 40, 60).select("gen")


@query(f"WITH {_GENS} SELECT CAST(max(max_chunk) AS BIGINT) AS max_chunk, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, max(gen) AS max_gen, count(*) AS n_generations FROM gens")
def index_fingerprint(spark, sf_dir):
    return lsm.fingerprint(_gens(spark, sf_dir)[1])


@query("SELECT CAST(l_orderkey AS BIGINT) AS chunk_id, count(DISTINCT l_suppkey % 7) AS n_generations FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey % 7) > 1")
def generation_conflicts(spark, sf_dir):
    return lsm.conflicts(_gens(spark, sf_dir)[0]).withColumn("chunk_id", F.col("chunk_id").cast("long"))


_WINNER = f"""{_GENS}, held AS (SELECT DISTINCT l_orderkey AS chunk_id, CAST(l_suppkey % 7 AS BIGINT) AS gen FROM lineitem),
win AS (SELECT chunk_id, gen FROM (SELECT chunk_id, gen, row_number() OVER (PARTITION BY chunk_id ORDER BY level DESC, created DESC, gen DESC) AS r FROM held JOIN gens USING (gen)) WHERE r = 1)"""


@query(f"WITH {_WINNER} SELECT CAST(chunk_id AS BIGINT) AS chunk_id, gen FROM win")
def lsm_winner(spark, sf_dir):
    return lsm.winners(*_gens(spark, sf_dir)).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@query(f"WITH {_WINNER} SELECT gen, count(*) AS n_tokens FROM lineitem JOIN win ON l_orderkey = chunk_id AND l_suppkey % 7 = gen GROUP BY gen")
def lsm_recovered(spark, sf_dir):
    return lsm.recovered(*_gens(spark, sf_dir)).groupBy("gen").agg(F.count("*").alias("n_tokens"))
