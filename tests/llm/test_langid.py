from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm.langid import UND, Model, grams_of, identify, letters, sample_rows
from tokenloom.llm.q_langid import op6_langid


def gram(x):
    return sum((ord(c) if c != " " else 1) << 21 * (len(x) - 1 - i) for i, c in enumerate(x))


def test_grams_are_the_set_of_grams():
    ids = {text: frozenset(grams_of(text).tolist()) for text in ("abc abd", "Abc, 12 ABD!!", "  abc  abd  ")}
    padded = " abc abd "
    assert set(ids.values()) == {frozenset(gram(padded[i : i + n]) for n in (1, 2, 3) for i in range(len(padded) - n + 1))}
    assert len(grams_of("123 !")) == 0 and letters("\U00010400a").tolist() == [0x10428, ord("a")]
    assert set(grams_of("\u4e2d\u6587\u5b57").tolist()) == {gram(" \u4e2d\u6587\u5b57 "[i : i + n]) for n in (1, 2, 3) for i in range(6 - n)}


def small_model(texts, landmarks=2, ridge=1e-2):
    return Model([(grams_of(t), label) for t, label in texts], landmarks=landmarks, ridge=ridge)


def test_kernel_is_the_share_of_common_grams():
    m = small_model([("aab b", "x"), ("bcc c", "y")])
    sets = [set(grams_of(t).tolist()) for t in ("aab b", "bcc c", "abc")]
    k = m.kernel([grams_of("abc"), grams_of("aab b")])
    for j in range(2):
        assert abs(k[0, j] - len(sets[2] & sets[j]) / np.sqrt(len(sets[2]) * len(sets[j]))) < 1e-6
    assert abs(k[1, 0] - 1) < 1e-6


def test_regression_by_hand():
    """Kernel by set operations, Nystroem map by a pseudo-inverse root, ridge regression by its normal equations."""
    texts = [("the cat sat on the mat", "en"), ("der hund lief in den wald", "de"), ("a dog ran to the wood", "en"), ("die katze sass auf der matte", "de"), ("the wood is dark and deep", "en"), ("le chat est sur le lit", "fr")]
    m = small_model(texts, landmarks=3, ridge=0.5)
    sets = [frozenset(grams_of(t).tolist()) for t, _ in texts]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    marks = sets  # every label has fewer than four texts beyond its share, so each text is a landmark
    between = np.array([[k(a, b) for b in marks] for a in marks])
    new = [frozenset(grams_of(t).tolist()) for t in ("the dog sat", "der wald ist tief", "sur le mat")]
    values, vectors = np.linalg.eigh(between)
    root = vectors / np.sqrt(values)
    phi = np.hstack([between @ root, np.ones((len(sets), 1))])
    labels = ["de", "en", "fr"]
    y = np.array([[1.0 if label == x else -1.0 for x in labels] for _, label in texts])
    w = np.linalg.inv(phi.T @ phi + 0.5 * np.eye(phi.shape[1])) @ phi.T @ y
    want = np.hstack([np.array([[k(a, b) for b in marks] for a in new]) @ root, np.ones((3, 1))]) @ w
    assert m.labels == labels and np.allclose(m.decide([np.array(sorted(x)) for x in new]), want, atol=1e-4)


def test_scripts_are_told_apart(spark):
    words = {
        "zh": "\u8fd9\u662f\u4e00\u4e2a\u5173\u4e8e\u5929\u6c14\u7684\u53e5\u5b50\u6211\u4eec\u4eca\u5929\u53bb\u516c\u56ed", "ja": "\u3053\u308c\u306f\u5929\u6c17\u306e\u6587\u3067\u3059\u4eca\u65e5\u516c\u5712\u3078\u884c\u304d\u307e\u3059",
        "ko": "\uc774\uac83\uc740\ub0a0\uc528\uc5d0\uad00\ud55c\ubb38\uc7a5\uc785\ub2c8\ub2e4\uc624\ub298\uacf5\uc6d0", "ru": "\u044d\u0442\u043e\u043f\u0440\u0435\u0434\u043b\u043e\u0436\u0435\u043d\u0438\u0435\u043e\u043f\u043e\u0433\u043e\u0434\u0435",
        "bg": "\u0442\u043e\u0432\u0430\u0435\u0438\u0437\u0440\u0435\u0447\u0435\u043d\u0438\u0435\u0437\u0430\u0432\u0440\u0435\u043c\u0435\u0442\u043e\u0449\u044a", "th": "\u0e19\u0e35\u0e48\u0e04\u0e37\u0e2d\u0e1b\u0e23\u0e30\u0e42\u0e22\u0e04\u0e40\u0e01\u0e35\u0e48\u0e22\u0e27\u0e01\u0e31\u0e1a\u0e2d\u0e32\u0e01\u0e32\u0e28", "en": "thisisasentenceabouttheweathertoday",
    }
    rng = np.random.default_rng(3)
    cut = lambda w: " ".join(w[i : i + int(rng.integers(2, 6))] for i in rng.integers(0, len(w) - 2, 30))
    rows = [(i, cut(words[label]), label) for i, label in enumerate(list(words) * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found, name = identify(df, F.col("doc_id") % 2 == 0)
    held = found.where("doc_id % 2 = 1").select("lang", F.col(f"{name}.lang").alias("got")).collect()
    assert all(r.lang == r.got for r in held) and len(held) == 140


def test_sample_is_bounded(spark):
    """Rows that repeat one id are one text of the sample; ids beyond the bound are left out, however they are partitioned."""
    options = {"doc_id": "doc_id", "text": "text", "label": "lang", "per_label": 50}
    same = spark.range(1000).selectExpr("1L AS doc_id", "concat('text ', id) AS text", "'en' AS lang").repartition(7)
    assert [tuple(r) for r in sample_rows(same, F.lit(True), **options).collect()] == [(1, "en", "text 0")]
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "IF(id % 3 = 0, 'en', 'de') AS lang")
    a, b = (sorted(map(tuple, sample_rows(x, F.lit(True), **options).collect())) for x in (many.repartition(5), many.union(many).coalesce(2)))
    assert a == b and len(a) == 100 and {x[0] for x in a} == set(range(1, 51))


def test_held_out_accuracy(spark, sf_dir):
    got = op6_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_odd_documents(odd, none):
    found, name = identify(odd, F.lit(True))
    assert name != "language"
    rows = found.select("doc_id", "text", F.col(f"{name}.lang").alias("l"), F.col(f"{name}.score").alias("s")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.l == UND) == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.s <= 1
        if r.text and r.text.startswith("le renard"):
            assert r.l == "fr"
    assert identify(none, F.lit(True))[0].count() == 0
    unlearned, name = identify(odd, F.lit(False))
    assert {r[0] for r in unlearned.select(f"{name}.lang").collect()} == {UND}
    single, name = identify(odd, F.col("lang") == "fr")
    assert {r[0] for r in single.where("doc_id = 1").select(f"{name}.lang").collect()} == {"fr"}
