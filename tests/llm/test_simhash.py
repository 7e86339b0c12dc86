from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import simhash as module
from tokenloom.llm.common import materialise, release
from tokenloom.llm.q_simhash import op8_simhash
from tokenloom.llm.simhash import _number, _possible, _verified, agreement, close_pairs, differences, forest_shape, keep_one, near_duplicates, odd_sketch, shingle_sets, simhash


def brute(rows):
    """rows (id, text) -> component of each row, by all pairs."""
    sets = [frozenset(s.tolist()) for s in shingle_sets([(t or "").encode() for _, t in rows])]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                group[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, None if d is None else least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def run(df, **options):
    return sorted(((r.doc_id, r.component_id) for r in near_duplicates(df, **options).collect()), key=repr)


def corpus(n=60, copies=6):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(n):
        base = rng.choice(words, 120).tolist()
        rows.append(base)
        for c in range(copies if i % 3 == 0 else 0):
            t = list(base)
            for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
                t[k] = f"new{i}{c}{k}"
            rows.append(t)
    ids = rng.permutation(len(rows)).tolist()
    return [(i, " ".join(r)) for i, r in zip(ids, rows)]


def test_against_all_pairs_on_a_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(((r.doc_id, r.component_id) for r in op8_simhash(spark, sf_dir).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("options", [{}, {"block": 8, "near": 1}])
def test_against_all_pairs(spark, options):
    """Also with buckets that are split into blocks and pairs that a first round leaves out."""
    rows = corpus()
    assert run(spark.createDataFrame(rows, "doc_id long, text string"), **options) == brute(rows)


def test_one_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        t = list(base)
        t[int(rng.integers(0, 150))] = f"only{i}"
        rows.append((1000 - i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {c for _, c in run(df, block=16)} == {881}
    assert keep_one(df).count() == 1


def test_sketch_agrees_as_often_as_expected():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100).astype(np.uint64)])
    share = 1 - np.unpackbits(simhash(a) ^ simhash(b)).mean()
    assert share > agreement(0.8) - 0.12
    depth, trees, bound = forest_shape(10**9, 0.8, 0.99)
    assert depth > 20 and 1 - (1 - agreement(0.8) ** depth) ** trees >= 0.99 and 39 < bound < 70


@pytest.mark.parametrize("n", [50_000, 3_000_000, 10**9])
def test_forest_reaches_its_recall_at_the_threshold(n):
    """Exactly, with bits drawn without repetition; also for a set of 15 shingles and 12 of them, the worst pair that the forest is for."""
    depth, trees, bound = forest_shape(n, 0.8, 0.99)
    for p in (agreement(0.8), 0.8388671875):
        found = 0.0
        for off in range(bound + 1):
            alike = math.comb(256 - off, depth) / math.comb(256, depth)
            found += math.comb(256, off) * (1 - p) ** off * p ** (256 - off) * (1 - (1 - alike) ** trees)
        assert found >= 0.99 - 1e-9


def test_short_documents_are_found_without_exception(spark):
    """Pairs of similarity 0.8 or a little more or less, of 4 to 18 shingles."""
    rows = []
    for i in range(400):
        n = 9 + i % 14
        words = [f"s{i}w{j}" for j in range(n)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[: -1 - (i % 3 == 2)])), (3 * i + 2, " ".join(["x", *words[1:]]))]
    assert run(spark.createDataFrame(rows[:300], "doc_id long, text string")) == brute(rows[:300])
    pairs = [r for i in range(300) for r in ((2 * i, " ".join(f"p{i}w{j}" for j in range(9))), (2 * i + 1, " ".join(f"p{i}w{j}" for j in range(8))))]
    assert all(c == d - d % 2 for d, c in run(spark.createDataFrame(pairs, "doc_id long, text string")))


@pytest.mark.parametrize("places", [None, 3])
def test_pairs_are_verified_by_their_sets(spark, places):
    """Also if the pairs of a class are spread over several places."""
    sets = {0: [*range(10)], **{i: [*range(10 - i % 4), *range(100 * i, 100 * i + i % 3)] for i in range(1, 12)}}
    pairs = [(0, i) for i in range(1, 12)] + [(i, 11) for i in range(1, 11)]
    df = spark.createDataFrame(list(sets.items()), "id long, set array<long>")
    hubs = places and spark.createDataFrame([(0, places), (11, places)], "id long, places int")
    got = {tuple(r) for r in _verified(spark.createDataFrame(pairs, "a long, b long"), df, 0.8, hubs).collect()}
    jaccard = lambda x, y: len({*x} & {*y}) / len({*x} | {*y})
    assert got == {(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= 0.8} and got


@pytest.mark.parametrize("n", [1, 14, 31, 32, 33, 500, 3000])
def test_sketches_never_show_more_differences_than_there_are(n):
    """Also between sketches of different lengths; at similarity 0.5 they show more than sets of 0.8 have."""
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 2**64, n, np.uint64))
    for keep in (0, n // 2, n - n // 9, n):
        for more in (0, n // 5, 3 * n):
            b = np.unique(np.concatenate([a[:keep], rng.integers(0, 2**64, more, np.uint64)]))
            off = len(np.setxor1d(a, b))
            if len(b):
                assert differences(odd_sketch(a), odd_sketch(b)) == differences(odd_sketch(b), odd_sketch(a)) <= off
    if n >= 500:
        b = np.concatenate([a[: 2 * n // 3], rng.integers(0, 2**64, n - 2 * n // 3, np.uint64)])
        assert differences(odd_sketch(a), odd_sketch(b)) > 2 * n / 9


@pytest.mark.parametrize("places", [None, 3])
def test_sketches_drop_no_pair_that_is_near(spark, places):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 90, np.uint64)
    sets = {0: base, **{i: np.concatenate([base[: 90 - i], rng.integers(0, 2**64, i, np.uint64)]) for i in range(1, 60)}}  # 10 differ: 80 of 100 in common
    df = spark.createDataFrame([(i, (len(s), odd_sketch(s))) for i, s in sets.items()], "id long, set struct<size: int, odd: binary>")
    hubs = places and spark.createDataFrame([(0, places)], "id long, places int")
    got = {r.b for r in _possible(spark.createDataFrame([(0, i) for i in range(1, 60)], "a long, b long"), df, 0.8, hubs).collect()}
    assert got >= set(range(1, 11)) and max(got) < 25


def test_sets_of_far_pairs_do_not_travel(spark, monkeypatch):
    """Groups of texts with two thirds of their shingles in common share buckets, but none of their pairs is left when the sets are fetched."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        base = [f"g{i}w{j}" for j in range(300)]
        rows += [(10 * i + c, " ".join([*base, *(f"g{i}c{c}x{k}" for k in range(80))])) for c in range(6)]
    rows += [(1000 + i, r + " end") for i, (_, r) in enumerate(rows[::20])]
    order = rng.permutation(len(rows)).tolist()
    pairs, verified = [], module._verified
    monkeypatch.setattr(module, "_verified", lambda p, *rest: pairs.extend(p.collect()) or verified(p, *rest))
    assert run(spark.createDataFrame([rows[i] for i in order], "doc_id long, text string")) == brute(rows)
    assert 12 <= len(pairs) < 60


@pytest.mark.parametrize("at_once", [1, 5])
def test_forest_is_filed_a_few_trees_at_a_time(spark, monkeypatch, at_once):
    filed, filer = [], module._filer
    monkeypatch.setattr(module, "_AT_ONCE", at_once)
    monkeypatch.setattr(module, "_FEW", 0)
    monkeypatch.setattr(module, "_filer", lambda depth, trees: filed.append(trees) or filer(depth, trees))
    rows = corpus(30, 3)
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    trees = forest_shape(len(rows), 0.8, 0.99)[1]
    assert max(map(len, filed)) <= at_once and [t for some in filed for t in some][:trees] == [*range(trees)]


def test_shuffle_files_of_the_last_step_are_let_go(spark):
    def files() -> set[str]:
        every = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (every.apply(i).getName() for i in range(every.length())) if n.endswith(".data")}

    before = files()
    materialise(spark.range(1000).withColumn("x", F.rand()).repartition("x").groupBy("id").count(), "test-shuffle")
    new = files() - before
    assert new
    release(spark)
    for _ in range(50):
        if not new & files():
            break
        time.sleep(0.1)
    assert not new & files()


def test_classes_with_a_common_half_are_told_apart(spark):
    df = spark.createDataFrame([(5, 1), (5, 2), (6, 1)], "h1 long, h2 long")
    assert [r[0] for r in df.select(_number([])).collect()] == [5, 5, 6]
    apart = [r[0] for r in df.select(_number([5])).collect()]
    assert len(set(apart)) == 3 and apart[2] == 6


def test_left_out_partners_are_named():
    """Class 4 is near to 1, 2 and 3, which are far from each other: with two partners at most, 3 has no pair and must be known to the last round."""
    rows = np.zeros(4, [("id", "<i8"), ("label", "<i8"), ("block", "<i4"), ("sim", "V32")])
    rows["id"] = rows["label"] = [1, 2, 3, 4]
    sims = np.zeros((4, 32), np.uint8)
    for i in range(3):
        sims[i, 5 * i : 5 * i + 5] = 255
    rows["sim"] = np.frombuffer(sims.tobytes(), "V32")
    a, b, left = close_pairs(rows, 64, 2)
    assert a.tolist() == [1, 2] and b.tolist() == [4, 4] and left.tolist() == [3, 4]


def test_odd_documents(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert run(odd) == brute(rows)
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    got = sorted(((r.doc_id, (r.text or "")[:5]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, "the q"), (3, ""), (4, ""), (5, "!!! ."), (None, "le re"), (6, "le re"), (7, "word0"), (7, "a sec"), (8, "é中\U0001f600 p"), (-9, " \t\n ")], key=repr)
    assert run(none) == [] and keep_one(none).count() == 0
