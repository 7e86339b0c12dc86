from __future__ import annotations

import numpy as np
import pytest

from tokenloom.llm.crosspolytope import Forest, _dense, hadamard, layout, link_vectors


def brute(rows, cosine=0.95):
    """vec_id, n_links, component, kept by all pairs; rows: (vec_id, list or None)."""
    def usable(r):
        x = r[1]
        return r[0] is not None and x is not None and len(x) > 0 and None not in x and np.isfinite(x).all() and np.any(x)

    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            a, b = rows[i][1], rows[j][1]
            if usable(rows[i]) and usable(rows[j]) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    links[i].add(j), links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        c = rows[i][0] if len(seen) == 1 else min(rows[j][0] for j in seen)
        out.append((rows[i][0], len(links[i]), c, rows[i][0] is None or c == rows[i][0]))
    return out


def run(spark, rows, kind="double", **options):
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], f"vec_id long, embedding array<{kind}>, n_links string")
    return [tuple(r) for r in link_vectors(df, **options).collect()]


def same(a, b):
    return sorted(a, key=repr) == sorted(b, key=repr)


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16)).astype(np.float32)
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1), rtol=1e-5)
    f = Forest(12, (16, 4), 3, 2)
    assert f.codes(x[:, :12], 1).shape == (5, 3)


def test_layout_grows_slowly():
    tables = [layout(n, 64, 0.95, 0.999, 2)[1] for n in (10**3, 10**5, 10**7, 10**9)]
    assert tables == sorted(tables) and tables[-1] < 40


@pytest.mark.parametrize("block", [4096, 8])
def test_all_links_are_found(spark, block):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 24))
    x = [b + rng.normal(0, s, 24) for b in base for s in (0, 0.1, 0.2, 0.3)] + [base[0] + rng.normal(0, 0.12, 24) for _ in range(60)] + [base[1]] * 30
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in zip(rng.permutation(len(x)), x)]
    got, want = run(spark, rows, "float", block=block), brute(rows)
    assert same(got, want)
    assert max(r[1] for r in want) > 40


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [3.0, 0.0, 0.0]), (11, [1e200, 1e199]), (12, [1e-200, 1e-201]), (13, [-1.0, 0.0]), (14, [5.0]), (15, [-5.0]), (16, [1.0])]
    assert same(run(spark, rows), brute(rows))
    assert run(spark, []) == []
    assert same(run(spark, rows[3:8]), brute(rows[3:8]))


def test_chains_join_components(spark):
    t = np.linspace(0, 2.0, 12)
    rows = [(100 - i, [float(np.cos(a)), float(np.sin(a)), 0.0, 0.0]) for i, a in enumerate(t)]
    got = run(spark, rows)
    assert same(got, brute(rows)) and len({r[2] for r in got}) == 1


def test_recall_that_cannot_be_had_is_an_error():
    with pytest.raises(ValueError, match="tables"):
        layout(10**9, 64, 0.5, 0.9999, 2)
    assert layout(10**9, 64, 0.8, 0.9999, 2)[1] > 64


def test_blocks_have_one_size(spark):
    """A bucket of 90 equal-looking vectors is cut into blocks of at most 16 or so, and so is one of 900."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16)
    for n in (90, 900):
        x = [(base + rng.normal(0, 0.01, 16)).astype(np.float32).tobytes() for _ in range(n)]
        forest = Forest(16, (16,), 2, 2)
        classes = spark.createDataFrame([(bytearray(v),) for v in x], "vec binary")
        found = _dense(classes, forest, "<f4", 16).collect()
        assert max(r.blocks for r in found) == -(-n // 16)


def test_links_of_many_tiles_are_counted(monkeypatch):
    """The same sums and joins, in tiles of a few pairs as in one."""
    from tokenloom.llm import crosspolytope

    rng = np.random.default_rng(2)
    kind = crosspolytope._member(8, "<f4")
    rows = np.zeros(60, kind)
    rows["id"], rows["n"], rows["home"] = rng.permutation(60), rng.integers(1, 4, 60), True
    rows["vec"] = np.repeat(rng.standard_normal((6, 8)), 10, 0) + rng.normal(0, 0.1, (60, 8))
    forest = Forest(8, (8,), 2, 2)
    one = crosspolytope.bucket_links(rows, forest, 0, 0, 0.9)
    monkeypatch.setattr(crosspolytope, "_TILE", 7)
    assert all((a == b).all() for a, b in zip(one, crosspolytope.bucket_links(rows, forest, 0, 0, 0.9))) and len(one[0]) > 20
