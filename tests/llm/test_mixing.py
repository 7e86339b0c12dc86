from __future__ import annotations

import numpy as np
import pytest

from tokenloom.llm.mixing import flight, landing, mix, plan_mix
from tokenloom.llm.q_mixing import op2_mixing


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(1)
    p = rng.uniform(0.05, 0.95, 500)
    w = np.stack([np.ones(500), rng.integers(0, 900, 500)], 1).astype(float)
    q = flight(p, w, rng)
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert np.allclose(p @ w, q @ w, rtol=1e-9)
    assert set(np.unique(landing(q, w))) <= {0.0, 1.0}


def test_flight_keeps_probabilities():
    p, w = np.full(6, 0.4), np.stack([np.ones(6), np.arange(1.0, 7)], 1)
    mean = np.mean([landing(flight(p, w, np.random.default_rng(s)), w) for s in range(4000)], 0)
    assert abs(mean.mean() - 0.4) < 0.08


@pytest.mark.parametrize("sizes", [[5] * 9, [0] * 9, [1]])
def test_flight_of_equal_units(sizes):
    n = len(sizes)
    q = flight(np.full(n, 0.3), np.stack([np.ones(n), sizes], 1).astype(float), np.random.default_rng(0))
    assert ((q > 0) & (q < 1)).sum() <= 2


def targets_by_hand(size: dict, most=3.0, weights=(5, 2, 1)) -> dict:
    order = sorted((k for k in size if k is not None)) + [None] * (None in size)
    w = {k: weights[i % 3] for i, k in enumerate(order)}
    fixed: dict = {}
    total = sum(size.values())
    while True:
        free = [k for k in order if k not in fixed]
        if not free:
            return fixed
        f = (total - sum(fixed.values())) / sum(w[k] for k in free)
        over = [k for k in free if w[k] * f > most * size[k]]
        if not over:
            return fixed | {k: w[k] * f for k in free}
        fixed |= {k: most * size[k] for k in over}


def test_contract(spark, sf_dir):
    got = op2_mixing(spark, sf_dir).toPandas()
    want = targets_by_hand(got.groupby("source")["size"].sum().to_dict())
    for source, part in got.groupby("source"):
        assert abs(part.target.iloc[0] - want[source]) < 1e-6 * max(1, want[source])
        assert part.source_size.iloc[0] == part["size"].sum()
        if len(part) > 3:
            assert abs(part.taken.sum() - part.target.iloc[0]) < 0.1 * part.target.iloc[0] + part["size"].max()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    again = op2_mixing(spark, sf_dir).toPandas()
    key = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))


def test_blocks_stay_on_target_however_partitioned(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"s{i % 3 if i % 2 else 0}", "w " * int(rng.integers(1, 60))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    a = plan_mix(docs.repartition(7), block=100).toPandas()
    for _, part in a.groupby("source_"):
        assert abs((part.copies_ * part.size_).sum() - part.target_.iloc[0]) < 0.01 * part.target_.iloc[0] + 5
    b = plan_mix(docs.coalesce(1), block=100).toPandas()
    assert dict(zip(a.id_, a.copies_)) == dict(zip(b.id_, b.copies_))


def test_capped_sources(spark):
    rows = [(1, "a", "x"), (2, "b", "x " * 1000), (3, None, "x " * 10)]
    p = {r.source_: r for r in plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    want = targets_by_hand({"a": 1, "b": 1000, None: 10})
    assert all(abs(p[k].target_ - want[k]) < 1e-6 for k in want)


def test_odd_documents(odd, none):
    got = mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and got.columns[-1] == "copies_"
    assert got.where("copies_ <= 0").count() == 0
    assert mix(none).count() == 0
    assert plan_mix(odd).selectExpr("sum(rows_)").first()[0] == odd.count()
    assert plan_mix(odd.where("trim(text) = '' or text is null")).selectExpr("sum(copies_ * size_)").first()[0] == 0
