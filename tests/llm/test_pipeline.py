from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from test_decontaminate import brute as windows_hit
from test_mixing import targets_by_hand
from test_secrets import base
from test_simhash import brute

from tokenloom.llm.langid import Model, grams_of


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf_dir).cache()
        out[name] = docs
        if name != "mixing":
            assert docs.columns == columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        kept = [r.doc_id for r in docs.select("doc_id").collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= ids
        if name == "language_id":
            # The sample holds all of so small a table, so the model is the one fitted here, text by text.
            rows = [(r.doc_id, r.text or "", r.lang) for r in before.collect()]
            learn = [r for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2]
            order = {r.i: r.key for r in spark.createDataFrame([(str(r[0]),) for r in learn], "i string").selectExpr("i", "xxhash64(i, 'langid') AS key").collect()}
            at = Counter()
            samples = []
            for i, t, lang in sorted(learn, key=lambda r: (order[str(r[0])], str(r[0]))):
                at[lang] += 1
                samples.append((at[lang], lang, grams_of(t)))
            model = Model([(g, lang) for _, lang, g in sorted(samples, key=lambda x: x[:2])], landmarks=96, ridge=1e-2)
            labels, scores = model.predict([t for _, t, _ in rows])
            assert set(kept) == {r[0] for r, lang, x in zip(rows, labels, scores) if lang != "und" and x >= corpus_pipeline.MIN_SCORE}
            clean = {r[0] for r in rows if len(r[1].split()) > 20}
            assert len(clean - set(kept)) <= 0.02 * len(ids)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(kept) == {r.doc_id for r in before.collect() if not windows_hit(r.text, items)[1]} != ids
        if name == "simhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert set(kept) == {d for d, c in brute(rows) if d == c}
        if name == "secret_scans":
            assert set(kept) == ids and all(not base(r.text) and r.n_chars == len(r.text) for r in docs.collect())
    mixed = out["mixing"].toPandas()
    before = out["secret_scans"].toPandas()
    size = {d: len(t.encode().split()) for d, t in zip(before.doc_id, before.text)}
    want = targets_by_hand(before.assign(w=before.doc_id.map(size)).groupby("source").w.sum().to_dict())
    assert mixed.copies.between(1, 3).all()
    for source, part in mixed.groupby("source"):
        taken = (part.doc_id.map(size) * part.copies).sum()
        assert abs(taken - want[source]) <= 0.1 * want[source] + max(size[d] for d in before.doc_id[before.source == source])


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[-1] == "copies" and 0 < got.count() <= 200


def test_odd_documents(spark, odd, none, sf_dir):
    """What each stage keeps of nulls, empty and long texts, ties, repeated rows and ids, with columns of clashing names."""
    docs = odd
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        kept[name] = sorted(((r.doc_id, (r.text or "")[:6]) for r in docs.collect()), key=repr)
        assert docs.columns[: len(odd.columns)] == odd.columns
    fox, renard = "the qu", "le ren"
    assert kept["language_id"] == sorted([(1, fox), (1, fox), (2, fox), (None, renard), (6, renard), (7, "word0 "), (7, "a seco"), (8, "\u00e9\u4e2d\U0001f600 pa")], key=repr)
    assert kept["simhash_near_dedup"] == sorted([(1, fox), (None, renard), (6, renard), (7, "word0 "), (7, "a seco"), (8, "\u00e9\u4e2d\U0001f600 pa")], key=repr)
    assert kept["benchmark_decontamination"] == kept["simhash_near_dedup"]
    assert kept["secret_scans"] == sorted([*(x for x in kept["simhash_near_dedup"] if x[0] != 8), (8, "\u00e9\u4e2d\U0001f600 [R")], key=repr)
    assert set(kept["mixing"]) <= set(kept["secret_scans"])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0


def test_the_session_is_left_as_it_was(spark, odd, sf_dir):
    before = spark.sparkContext.getConf().getAll(), spark.conf.getAll
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, sf_dir)
    assert (spark.sparkContext.getConf().getAll(), spark.conf.getAll) == before
