from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import lm
from tokenloom.llm.common import fold
from tokenloom.llm.q_lm import op4_lm


def words(text):
    return (text or "").encode().lower().split() + [b"</>"]


def by_hand(texts, role, weights, order=2):
    """Base and model score of each text. role: True learns; weights by bucket."""
    grams = [Counter() for _ in range(order)]
    contexts = [Counter() for _ in range(order)]
    for t, r in zip(texts, role):
        if r:
            for k, h, w in ngrams(words(t), order):
                grams[k - 1][h, w] += 1
                contexts[k - 1][h] += 1
    c = Counter({w: x for (_, w), x in grams[0].items()})
    n, v = sum(c.values()), len(c)
    out = []
    for t in texts:
        ws = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(weights[b] @ e) for b, e in events(ws, grams, contexts, n, v, order))
        out.append((len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


def ngrams(ws, order):
    """(k, the k - 1 words before, word) for each word and k; a context ends at the start of the text."""
    for i, w in enumerate(ws):
        for k in range(1, order + 1):
            yield k, (None, *ws[:i])[-(k - 1) :] if k > 1 else (), w


def events(ws, grams, contexts, n, v, order):
    """The bucket and the estimates of each word, the highest order first."""
    at = list(ngrams(ws, order))
    for i in range(len(ws)):
        bucket, e = 0, [1 / (v + 1)]
        for k, h, w in at[i * order : (i + 1) * order]:
            seen = contexts[k - 1][h] if k > 1 else n
            e.insert(0, grams[k - 1][h, w] / seen if seen else 0.0)
            if k > 1 and seen:
                bucket = (k - 2) * lm.BUCKETS + int(lm.bucket_of(np.array([seen]))[0])
        yield bucket, np.array(e)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_counting_by_hand(spark, sf_dir, monkeypatch, order):
    learned = []
    learn = lm._learn
    monkeypatch.setattr(lm, "_learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 7)
    got = (op4_lm(spark, sf_dir) if order == 2 else lm.score(table, remainder != 2, remainder == 5, order=3).withColumn("held_out", remainder == 2)).toPandas().set_index("doc_id")
    docs = table.toPandas()
    role = [zlib.crc32(str(i).encode()) % 7 != 2 for i in docs.doc_id]
    for i, r, want in zip(docs.doc_id, role, by_hand(docs.text, role, learned[0], order)):
        g = got.loc[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (not r, *want[:3])
        assert abs(g.base_score - want[3]) < 1e-6 * abs(want[3]) + 1e-9 and abs(g.score - want[4]) < 1e-6 * abs(want[4]) + 1e-9
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()  # the model predicts unseen text better than the base
    assert np.allclose(learned[0].sum(1), 1) and (learned[0] > 0).all()


@pytest.mark.parametrize("order", [2, 3])
def test_weights_follow_expectation_maximisation(spark, sf_dir, monkeypatch, order):
    """Against expectation maximisation over every single held-out event, to its end."""
    learned = []
    learn = lm._learn
    monkeypatch.setattr(lm, "_learn", lambda *a: learned.append(learn(*a)) or learned[-1])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = fold(F.col("doc_id"), 7)
    lm.score(docs, remainder != 2, remainder == 5, order=order)
    grams, contexts = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    rows = [(zlib.crc32(str(r.doc_id).encode()) % 7, words(r.text)) for r in docs.collect()]
    for x, ws in rows:
        if x not in (2, 5):
            for k, h, w in ngrams(ws, order):
                grams[k - 1][h, w] += 1
                contexts[k - 1][h] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    found = defaultdict(list)
    for x, ws in rows:
        if x == 5:
            for b, e in events(ws, grams, contexts, n, v, order):
                found[b].append(e)
    assert len(found) > 5
    for b, e in found.items():
        e, w = np.array(e), np.full(order + 1, 1 / (order + 1))
        for _ in range(3000):
            p = w * e
            w = (p / p.sum(1, keepdims=True)).mean(0)
        assert np.abs(learned[0][b] - w).max() < 0.005


def test_exchange_grows_with_the_corpus():
    """Rows of the exchange are batches times parts: never more than the tokens over 64, from megabytes to petabytes, with batches that fit a task."""
    for text_bytes in (10**9, 10**11, 10**12, 10**14, 10**15):
        tokens = text_bytes // 6
        batch, part = lm.exchange_shape(text_bytes, tokens)
        assert math.ceil(text_bytes / batch) * math.ceil(tokens / part) <= 1.1 * tokens / 64
        assert batch <= max(10 << 20, 20 * math.sqrt(text_bytes))


def test_odd_documents(odd, none):
    cond = fold(F.col("doc_id"), 7)
    got = lm.score(odd, cond != 2, cond == 5).collect()
    assert len(got) == odd.count()
    null = [r for r in got if r.doc_id is None]
    assert len(null) == 1 and null[0].n_tokens == 10
    assert sorted(r.n_tokens for r in got if r.doc_id in (3, 4, -9)) == [1, 1, 1]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert lm.score(none, cond != 2, cond == 5).count() == 0
    untaught = lm.score(odd, F.lit(False), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and abs(r.base_score) < 1e-12 for r in untaught)
