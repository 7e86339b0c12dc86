"""Queries over scalar, vector and codec functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from ..functions import vectors as V
from ..operators.embed import windows
from .inputs import DOCS, TOKENS, documents, sql_terms, table, tokens

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add




@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash("text").alias("hash"))


@query(f"""WITH {DOCS} SELECT uuid, sha256(CASE WHEN CAST(uuid AS BIGINT) % 3 = 0 THEN body WHEN length(title) >= 20 THEN title || chr(10) || body
ELSE title || chr(10) || substr(body, 1, 200) || chr(10) || body END) AS digest FROM docs""")
def embedding_text(spark, sf_dir):
    d = documents(spark, sf_dir)
    title = F.when(F.col("uuid").cast("long") % 3 != 0, F.col("title"))
    return d.select("uuid", F.sha2(X.embedding_text(title, F.col("body")), 256).alias("digest"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '{"lang":"' || lang || '","source":"' || source || '"}' END AS metadata FROM documents""")
def metadata_json(spark, sf_dir):
    full = F.create_map(F.lit("source"), "source", F.lit("lang"), "lang")
    m = F.when(F.col("doc_id") % 5 != 0, full).otherwise(F.create_map().cast("map<string,string>"))
    return table(spark, sf_dir, "documents").select("doc_id", X.metadata_json(m).alias("metadata"))


@query(f"SELECT doc_id, CAST(len({sql_terms('text')}) AS BIGINT) AS n_terms, sha256(array_to_string({sql_terms('text')}, ' ')) AS digest FROM documents")
def text_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.terms("text")).cast("long").alias("n_terms"), F.sha2(F.array_join(X.terms("text"), " "), 256).alias("digest"))


@query(r"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda t: '"' || t || '"'), ' ') AS query FROM benchmark""")
def match_query(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.match_query("text").alias("query"))


@query("SELECT item_id, strip_accents(text) AS folded FROM benchmark")
def fold_accents(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", X.fold_accents("text").alias("folded"))


@query(f"WITH {TOKENS} SELECT a.token, round(list_dot_product(a.vec, b.vec), 6) AS dot FROM tokens a, tokens b WHERE b.token = 0")
def dot_product(spark, sf_dir):
    t = tokens(spark, sf_dir)
    return t.crossJoin(F.broadcast(t.where("token = 0").select(F.col("vec").alias("v0")))).select("token", F.round(V.dot("vec", "v0"), 6).alias("dot"))


@query(f"""WITH {TOKENS}, s AS (SELECT a.token, list_transform(list_zip(a.vec, b.vec), lambda p: p[1] + p[2]) AS v, list_transform(list_zip(a.vec, b.vec), lambda p: p[1] - p[2]) AS w FROM tokens a, tokens b WHERE b.token = 1)
SELECT token, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS plus, round(list_sum(list_transform(w, lambda x: x * x)), 6) AS minus, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first FROM s""")
def vector_arithmetic(spark, sf_dir):
    t = tokens(spark, sf_dir)
    p = t.crossJoin(F.broadcast(t.where("token = 1").select(F.col("vec").alias("v1")))).select("token", V.add("vec", "v1").alias("v"), V.subtract("vec", "v1").alias("w"))
    return p.select("token", F.round(V.dot("v", "v"), 6).alias("plus"), F.round(V.dot("w", "w"), 6).alias("minus"), F.round(V.normalise("v")[0], 6).alias("first"))


_LEVEL = "least(greatest(round(sign(x) * ln(1 + 255 * abs(x / 0.25)) / ln(256.0) * 7.5 + 7.5), 0), 15)"


@query(f"WITH {TOKENS} SELECT token, array_to_string(list_transform(vec, lambda x: CAST({_LEVEL} AS INTEGER)), ',') AS levels FROM tokens")
def residual_levels(spark, sf_dir):
    return tokens(spark, sf_dir).select("token", V.join_ints(V.encode_levels("vec")).alias("levels"))


@query(f"""WITH {TOKENS}, l AS (SELECT token, vec, list_transform(vec, lambda x: ({_LEVEL} - 7.5) / 7.5) AS y FROM tokens),
d AS (SELECT token, vec, list_transform(y, lambda v: sign(v) * (pow(256.0, abs(v)) - 1) / 255 * 0.25) AS back FROM l)
SELECT token, round(list_sum(list_transform(list_zip(vec, back), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / len(vec), 6) AS error FROM d""")
def residual_round_trip(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("back", V.decode_levels(V.encode_levels("vec")))
    off = V.subtract("vec", "back")
    return t.select("token", F.round(V.dot(off, off) / F.size("vec"), 6).alias("error"))


@query("""SELECT CAST(i AS BIGINT) AS level, round((CASE WHEN i < 7.5 THEN -1 ELSE 1 END) * (pow(256.0, abs((i - 7.5) / 7.5)) - 1) / 255 * 0.25, 9) AS value FROM unnest(range(0, 16)) AS r(i)""")
def residual_table(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("level"), F.round(V.value_of(F.col("id")), 9).alias("value"))


@query("SELECT CAST(i AS BIGINT) AS level, CAST(1024 * pow(16, i + 1) AS BIGINT) AS capacity FROM unnest(range(0, 6)) AS r(i)")
def level_capacity(spark, sf_dir):
    return spark.range(6).select(F.col("id").alias("level"), V.level_capacity(F.col("id")).alias("capacity"))


@query("""SELECT CAST(d AS BIGINT) AS distance, CAST((CASE WHEN d > 0 THEN 16 ELSE 0 END) + (CASE WHEN abs(d) < 8 THEN abs(d)
ELSE least(8 + floor(ln(abs(d) / 8.0) / ln(16.0) * 8), 15) END) AS BIGINT) AS bucket FROM unnest(range(-200, 201)) AS r(d)""")
def relative_position_bucket(spark, sf_dir):
    return spark.range(-200, 201).select(F.col("id").alias("distance"), V.relative_bucket(F.col("id")).alias("bucket"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns, CAST(sum(turn) AS BIGINT) AS total FROM conversations GROUP BY conv_id")
def int_list_codec(spark, sf_dir):
    joined = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(V.join_ints(F.array_sort(F.collect_list("turn"))).alias("turns"))
    return joined.select("conv_id", "turns", F.aggregate(V.split_ints("turns"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT event_id, epoch_us(ts) AS micros, round(epoch_us(ts) / 1000000.0, 3) AS seconds FROM events")
def epoch_codec(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3).alias("seconds"))


_DELTAS = """d AS (SELECT c, t, c - coalesce(lag(c) OVER w, 0) AS d_major, CASE WHEN coalesce(c - lag(c) OVER w, 1) <> 0 THEN t ELSE t - lag(t) OVER w END AS d_minor
FROM (SELECT conv_id AS c, turn AS t FROM conversations) WINDOW w AS (ORDER BY c, t))"""


def _deltas(spark, sf_dir):
    """Pairs (conv_id, turn) as differences. The order runs within blocks of ids, so that no task sorts everything."""
    p = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"))
    within = W.partitionBy("c").orderBy("t")
    ids = p.select("c").distinct().withColumn("before", F.lag("c").over(W.orderBy("c")))
    d = p.join(ids, "c").withColumn("last", F.lag("t").over(within))
    first = F.col("last").isNull()
    return d.select("c", "t", F.when(first, F.col("c") - F.coalesce("before", F.lit(0))).otherwise(0).alias("d_major"), F.when(first, F.col("t")).otherwise(F.col("t") - F.col("last")).alias("d_minor"))


@query(f"WITH {_DELTAS} SELECT c, t, CAST(d_major AS BIGINT) AS d_major, CAST(d_minor AS BIGINT) AS d_minor FROM d")
def delta_encode(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query("SELECT conv_id AS c, turn AS t FROM conversations")
def delta_decode(spark, sf_dir):
    """The pairs again, from their differences: a running sum that starts anew with each major."""
    d = _deltas(spark, sf_dir).withColumn("at", F.struct("c", "t"))
    majors = d.groupBy("c").agg(F.sum("d_major").alias("d_major"), F.min("at").alias("at"))
    whole = majors.select("c", F.sum("d_major").over(W.orderBy("at")).alias("major"))
    return d.join(whole, "c").select(F.col("major").alias("c"), F.sum("d_minor").over(W.partitionBy("c").orderBy("at")).alias("t"))


@query(f"""WITH n AS (SELECT doc_id, len({sql_terms('text')}) AS n FROM documents)
SELECT doc_id, array_to_string(CASE WHEN n <= 0 THEN [] WHEN n <= 512 THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, n - 512 + 1, 256), [n - 512]))) END, ',') AS starts FROM n""")
def sliding_windows(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", F.size(X.terms("text")).cast("long").alias("n"))
    return n.select("doc_id", F.array_join(windows(F.col("n")), ",").alias("starts"))


_TOY = "list_transform(range(0, 16), lambda i: CAST(('0x' || substr(sha256(w || ':' || i), 1, 8)) AS BIGINT) / 2147483648.0 - 1)"


@query(f"""WITH t AS (SELECT item_id, w, i - 1 AS token_offset FROM (SELECT item_id, string_split_regex(lower(trim(text)), '\\s+') AS ws FROM benchmark) s, unnest(range(1, len(ws) + 1)) AS r(i), LATERAL (SELECT ws[i] AS w)),
v AS (SELECT item_id, token_offset, {_TOY} AS x FROM t)
SELECT item_id, CAST(token_offset AS BIGINT) AS token_offset, round(x[1] / sqrt(list_dot_product(x, x)), 4) AS first, round(x[16] / sqrt(list_dot_product(x, x)), 4) AS last FROM v""")
def hash_embedder(spark, sf_dir):
    from ..operators.embed import HashEmbedder, embed

    e = embed(table(spark, sf_dir, "benchmark"), HashEmbedder(), id="item_id", text="text")
    return e.select("item_id", F.col("token_offset").cast("long").alias("token_offset"), F.round(F.col("vec")[0].cast("double"), 4).alias("first"), F.round(F.col("vec")[15].cast("double"), 4).alias("last"))


_V = "v AS (SELECT token, vec, list_sum(list_transform(vec, lambda x: x * x)) AS sq, list_max(vec) AS top FROM tokens)"


@query(f"WITH {TOKENS}, {_V} SELECT token, round(vec[1] / sqrt(sq / 64 + 1e-6), 6) AS first, round(vec[64] / sqrt(sq / 64 + 1e-6), 6) AS last FROM v")
def rms_norm(spark, sf_dir):
    t = tokens(spark, sf_dir)
    size = F.sqrt(V.dot("vec", "vec") / F.size("vec") + 1e-6)
    return t.select("token", F.round(F.col("vec")[0] / size, 6).alias("first"), F.round(F.col("vec")[63] / size, 6).alias("last"))


@query(f"WITH {TOKENS}, {_V} SELECT token, round(exp(vec[1] - top) / list_sum(list_transform(vec, lambda x: exp(x - top))), 6) AS first FROM v")
def softmax(spark, sf_dir):
    t = tokens(spark, sf_dir).withColumn("top", F.array_max("vec"))
    e = F.transform("vec", lambda x: F.exp(x - F.col("top")))
    return t.select("token", F.round(e[0] / F.aggregate(e, F.lit(0.0), lambda a, x: a + x), 6).alias("first"))


_GELU = "0.5 * x * (1 + tanh(sqrt(2 / pi()) * (x + 0.044715 * x * x * x)))"


@query(f"WITH {TOKENS} SELECT token, round(list_sum(list_transform(range(1, 33), lambda i: list_transform([vec[i]], lambda x: {_GELU})[1] * vec[i + 32])), 6) AS total FROM tokens")
def gated_gelu(spark, sf_dir):
    gelu = lambda x: 0.5 * x * (1 + F.tanh(F.sqrt(2 / F.pi()) * (x + 0.044715 * x * x * x)))
    t = tokens(spark, sf_dir)
    gated = F.zip_with(F.slice("vec", 1, 32), F.slice("vec", 33, 32), lambda g, u: gelu(g) * u)
    return t.select("token", F.round(F.aggregate(gated, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {TOKENS} SELECT a.token, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] + p[2]))), 6) AS total FROM tokens a JOIN tokens b ON b.token = a.token + 1")
def residual_add(spark, sf_dir):
    t = tokens(spark, sf_dir).select("token", "vec")
    after = t.select((F.col("token") - 1).alias("token"), F.col("vec").alias("next"))
    return t.join(after, "token").select("token", F.round(F.aggregate(V.add("vec", "next"), F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query("""SELECT conv_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * i)), 6) AS total FROM (
SELECT conv_id, list(x ORDER BY pos) AS v FROM (SELECT conv_id, pos, avg(x) AS x FROM (
SELECT conv_id, turn, i AS pos, CAST(length(text) AS DOUBLE) * i AS x FROM conversations, unnest(range(0, 4)) AS r(i)) GROUP BY 1, 2) GROUP BY 1)""")
def positional_mean(spark, sf_dir):
    """Mean by position over overlapping rows, the core of merging windows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.char_length("text").cast("double").alias("n"))
    each = c.select("conv_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("n") * i)).alias("pos", "x"))
    mean = each.groupBy("conv_id", "pos").agg(F.avg("x").alias("x"))
    return mean.groupBy("conv_id").agg(F.round(F.sum(F.col("x") * (F.col("pos") + 1)), 6).alias("total"))
