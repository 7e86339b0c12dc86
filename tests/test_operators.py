from __future__ import annotations

import datetime as dt
import json
import sqlite3
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.operators import kmeans, lsm, maintain, maxsim, ranking, textsearch
from tokenloom.operators.embed import HashEmbedder, InputTooLarge, SeededEmbedder, ToyEmbedder, embed, merge_windows
from tokenloom.operators.filters import All, And, DateRange, MetadataEquals, Not, Or, UuidIn, apply
from tokenloom.operators.tokenizer import Unigram, tokenise


@pytest.fixture(scope="module")
def docs(spark):
    day = dt.datetime(2024, 1, 1)
    rows = [("a", day, {"tag": "alpha"}), ("b", day + dt.timedelta(days=1), {"tag": "beta"}), ("c", None, {}), ("d", day, None)]
    return spark.createDataFrame(rows, "uuid string, date timestamp, metadata map<string,string>")


@pytest.mark.parametrize(
    ("filter", "want"),
    [
        (All(), "abcd"),
        (And(), "abcd"),
        (Or(), ""),
        (UuidIn(()), ""),
        (Not(UuidIn(())), "abcd"),
        (MetadataEquals("tag", "alpha"), "a"),
        (~MetadataEquals("tag", "alpha"), "bcd"),
        (DateRange(), "abcd"),
        (DateRange(start=dt.datetime(2024, 1, 2)), "b"),
        (DateRange(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1)), "ad"),
        (~DateRange(end=dt.datetime(2024, 1, 1)), "bc"),
        (UuidIn(("a", "c")) & ~MetadataEquals("tag", "alpha"), "c"),
        (UuidIn(tuple("ab") + tuple(map(str, range(2000)))), "ab"),
    ],
)
def test_filters_are_two_valued(docs, filter, want):
    assert "".join(sorted(r.uuid for r in apply(docs, filter).collect())) == want


def test_filter_reaches_the_scan(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("uuid", F.col("source"))
    plan = apply(d, UuidIn(("src1",)))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "src1" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_bm25_equals_sqlite_fts5(spark):
    rows = [("1", "red fox", "the quick red fox jumps"), ("2", "blue", "a blue whale and a red crab crab"), ("3", None, "nothing here"), ("4", "red", "fox fox fox"), ("5", "crab", "red red red fox")]
    docs = spark.createDataFrame(rows, "uuid string, title string, body string")
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(title, body)")
    c.executemany("INSERT INTO t(rowid, title, body) VALUES (?, ?, ?)", [(int(a), b, x) for a, b, x in rows])
    for q in ("red fox", "crab", "fox fox", "whale"):
        want = dict(c.execute("SELECT rowid, -bm25(t, 3.0, 1.0) FROM t WHERE t MATCH ?", (" ".join(f'"{x}"' for x in q.split()),)).fetchall())
        got = {int(r.uuid): r.score for r in textsearch.bm25(docs, q).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert textsearch.bm25(docs, " .,!").count() == 0


def test_pruned_without_limits_is_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i % 2, i % 4, i // 6, v[i].tolist()) for i in range(60)]
    postings = spark.createDataFrame(rows, "gen int, bucket int, doc int, vec array<double>")
    centroids = postings.groupBy("gen", "bucket").agg(F.first("vec").alias("center"), F.count("*").alias("n"))
    q = spark.createDataFrame([(0, v[0].tolist()), (1, v[7].tolist()), (2, v[7].tolist())], "q int, qvec array<double>")
    exact = {r.doc: r.score for r in maxsim.exact(q, postings).collect()}
    got = {r.doc: r.score for r in maxsim.pruned(q, centroids, postings, k=100, token_budget=30, threshold=-2.0).collect()}
    assert got.keys() == exact.keys() and all(abs(got[k] - exact[k]) < 1e-9 for k in exact)
    few = maxsim.pruned(q, centroids, postings, k=1, token_budget=1, threshold=0.0)
    assert all(r.score >= 0 for r in few.collect())


def test_budget_includes_the_crossing_bucket(spark):
    q = spark.createDataFrame([(0, [1.0, 0.0])], "q int, qvec array<double>")
    rows = [(0, i, [1.0 - i / 10, 0.0], n) for i, n in enumerate((5, 0, 6, 7))]
    c = spark.createDataFrame(rows, "gen int, bucket int, center array<double>, n long")
    taken = lambda **k: [r.bucket for r in maxsim.select_centroids(q, c, **k).orderBy("place").collect()]
    assert taken(k=9, token_budget=11) == [0, 1, 2]
    assert taken(k=2, token_budget=99) == [0, 1]
    assert maxsim.missing_baseline(maxsim.select_centroids(q, c, k=9, token_budget=11)).count() == 0
    assert abs(maxsim.missing_baseline(maxsim.select_centroids(q, c, k=2, token_budget=99)).first().missing - 0.9) < 1e-9


def test_fusion_by_hand(spark):
    v = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.8)], "uuid string, score double")
    t = spark.createDataFrame([("c", 3.0), ("d", 2.0)], "uuid string, score double")
    got = [(r.uuid, round(r.score, 9)) for r in ranking.fuse(v, t, top=9).collect()]
    assert got == [("c", round(1 / 63 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("b", round(1 / 62, 9)), ("d", round(1 / 62, 9))]
    assert ranking.fuse(v, t, top=0).count() == 0
    assert [r.uuid for r in ranking.fuse(v, t, top=9, budget=1).collect()] == ["a", "c"]


def test_kmeans_finds_three_clusters_and_ties_go_low(spark):
    rng = np.random.default_rng(5)
    base = np.eye(3, 8)
    x = np.concatenate([b + rng.normal(0, 0.05, (40, 8)) for b in base])
    points = spark.createDataFrame([(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "id int, vec array<double>")
    centers = kmeans.fit(points, 3, iterations=8, seed=1)
    got = kmeans.assign(points, centers).toPandas().sort_values("id")
    assert got.groupby(got.id // 40).bucket.nunique().eq(1).all() and got.bucket.nunique() == 3
    twin = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0])], "bucket int, center array<double>")
    one = spark.createDataFrame([(0, [1.0, 0.0])], "id int, vec array<double>")
    assert kmeans.assign(one, twin).first().bucket == 0


def test_cascade():
    c = lsm.IndexConfig(base=10, fanout=2)
    assert lsm.cascade_level(20, {}, c) == 0
    assert lsm.cascade_level(15, {0: 10}, c) == 1
    assert lsm.cascade_level(15, {0: 10, 1: 30}, c) == 2
    with pytest.raises(ValueError):
        lsm.IndexConfig(fanout=1)


def test_upsert_takes_the_last(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "uuid string, body string")
    new = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("c", "4", 1)], "uuid string, body string, at int")
    assert sorted(map(tuple, maintain.upsert(old, new, order="at").collect())) == [("a", "3"), ("b", "1"), ("c", "4")]


def test_embedders(spark):
    df = spark.createDataFrame([(1, "One two one"), (2, ""), (3, None)], "id long, text string")
    rows = embed(df, HashEmbedder(), id="id", text="text").orderBy("token_offset").collect()
    assert [(r.id, r.token_offset) for r in rows] == [(1, 0), (1, 1), (1, 2)]
    assert rows[0].vec == rows[2].vec and abs(sum(x * x for x in rows[0].vec) - 1) < 1e-5
    assert embed(df, HashEmbedder(), id="id", text="text", query=True, min_surface=3).count() == 0
    assert ToyEmbedder().encode("a b").shape == (2, 16)
    assert (SeededEmbedder(8).encode("x y")[0] != SeededEmbedder(8).encode("x z")[0]).any()
    small = HashEmbedder(overflow="reject")
    small.max_tokens = 2
    with pytest.raises(InputTooLarge):
        small.encode("a b c")
    with pytest.raises(ValueError):
        HashEmbedder(dims=3)


def test_window_merge(spark):
    rows = [(1, 0, 2.0, [1.0, 0.0]), (1, 0, 2.0, [0.0, 1.0]), (1, 1, 0.5, [1.0, 0.0]), (1, 2, 2.0, [1.0, 0.0]), (1, 2, 2.0, [-1.0, 0.0])]
    got = merge_windows(spark.createDataFrame(rows, "doc int, pos int, raw_norm double, vec array<double>")).collect()
    assert [(r.pos, [round(x, 6) for x in r.vec]) for r in got] == [(0, [0.707107, 0.707107])]


def test_tokenizer(spark):
    pieces = [("<unk>", 0.0), ("▁he", -1.0), ("llo", -1.5), ("▁hello", -2.0), ("▁", -3.0), ("w", -4.0), ("▁wor", -2.0), ("ld", -2.0)]
    data = {
        "model": {"type": "Unigram", "unk_id": 0, "vocab": [list(p) for p in pieces]},
        "added_tokens": [{"id": 8, "content": "</s>", "special": True, "rstrip": True}],
        "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}, {"type": "Replace", "pattern": {"Regex": " +"}, "content": " "}]},
        "pre_tokenizer": {"type": "Metaspace", "prepend_scheme": "always"},
        "post_processor": {"type": "TemplateProcessing", "single": [{"Sequence": {"id": "A"}}, {"SpecialToken": {"id": "</s>"}}], "special_tokens": {"</s>": {"ids": [8]}}},
    }
    t = Unigram.load(json.dumps(data).encode())
    assert t.encode("hello world") == [3, 6, 7, 8]
    assert t.encode("hello  ŵŵ") == [3, 4, 0, 8]
    assert t.encode("") == [8]
    assert t.encode("hello</s> world") == [3, 8, 6, 7, 8]
    assert t.decode([3, 6, 7, 8]) == "hello world"
    df = spark.createDataFrame([(1, "hello"), (2, None)], "id int, text string")
    assert [r.ids for r in tokenise(df, t, id="id", text="text").orderBy("id").collect()] == [[3, 8], []]


def charsmap(entries: dict[str, str]) -> bytes:
    """A map with a hand-laid double array: every node gets a free block of 256 units."""
    import struct

    root: dict = {}
    texts = b""
    for k, v in entries.items():
        node = root
        for c in k.encode():
            node = node.setdefault(c, {})
        node[None] = len(texts)
        texts += v.encode() + b"\0"
    units, blocks = [0] * 65536, iter(range(256, 65536, 256))

    def lay(node, at):
        block = next(blocks)
        offset = at ^ block
        units[at] |= (offset >> 8) << 10 | 1 << 9 if offset & 255 == 0 else offset << 10
        if None in node:
            units[at] |= 1 << 8
            units[block] = node[None] | 1 << 31
        for c, child in node.items():
            if c is not None:
                units[block ^ c] = c
                lay(child, block ^ c)

    lay(root, 0)
    body = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(body)) + body + texts


def test_precompiled_normalizer():
    import base64

    from tokenloom.operators.tokenizer import CharsMap

    data = charsmap({"\u00a0": " ", "ﬁ": "fi", "Å": "A", "ÅÅ": "double", "x": ""})
    m = CharsMap(data)
    assert m.normalise("ﬁne\u00a0Å ÅÅ yxz\U0001f600") == "fine A double yz\U0001f600"
    t = Unigram([("<unk>", 0.0), ("▁fi", -1.0)], unk=0, normalizers=[{"type": "Precompiled", "precompiled_charsmap": base64.b64encode(data).decode()}])
    assert t.encode("ﬁ") == [1]
    assert Unigram([("▁a", 0.0)], normalizers=[{"type": "Precompiled"}]).encode("a") == [0]
    with pytest.raises(ValueError):
        CharsMap(b"\xff\0\0\0")


def test_accents(spark):
    from tokenloom.functions.text import fold_accents

    words = ["Élève", "naïve", None, "straße"]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fold_accents("w")).collect()]
    assert got == [w and "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)) for w in words]
