import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, v string, anchor int, score long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def whole(rows):
    return [(i, [int(np.floor(256 * c)) for c in v], y) for i, v, y in rows
            if i is not None and v is not None and y is not None and all(c is not None and np.isfinite(c) for c in v)]


def brute(rows, anchor):
    rows, out = whole(rows), []
    for i, v, y in filter(anchor, rows):
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in rows if j != i and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for ps, p, _ in [s for s in scored if s[2] == y][:5]:
            near = [(s, j) for s, j, z in scored if z != y and 50 * ps <= 100 * s <= 95 * ps]
            out += [(i, p, k + 1, j, ps, s) for k, (s, j) in enumerate(near[:3])]
    return sorted(out)


def mined(spark, rows, **more):
    out = hn.mine_hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


def clustered(seed, n, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, d))
    which = rng.integers(0, 6, n)
    x = centres[which] + rng.normal(size=(n, d)) * 0.4
    return [(int(i), v.tolist(), int((w + (rng.random() < 0.3)) % 4)) for i, (v, w) in enumerate(zip(x, which))]


@pytest.mark.parametrize("more", [{}, {"round_bytes": 2000}])
def test_against_brute_force(spark, monkeypatch, more):
    if more:
        monkeypatch.setattr(hn, "TREE", 16)
    rows = clustered(1, 400)
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]  # one vector in a third of the rows
    rows += [(10, rows[10][1], rows[10][2]), (10, rows[10][1], 3), (11, rows[12][1], 0)]
    rows += [(None, [1.0] * 8, 1), (2000, None, 1), (2005, [1.0] * 8, None), (2010, [None] * 8, 1), (2015, [float("nan")] * 8, 1),
             (2020, [float("inf")] * 8, 1), (2025, [1.0, 2.0], 1), (2026, [1.0, 1.5], 1), (2027, [0.5, 1.0], 2), (2030, [0.0] * 8, 2),
             (2035, [], 1), (2036, [], 1), (2037, [], 2)]
    want = brute(rows, lambda r: r[0] % 5 == 0)
    assert mined(spark, rows, **more) == want and len(want) > 300


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(300, 16)))
    a = np.floor(256 * (rng.normal(size=(3, 16))[rng.integers(0, 3, 60)] + 0.05 * rng.normal(size=(60, 16))))
    tree = hn.Tree.unpack(hn.Tree.spanning(np.arange(60), np.zeros(60, int), a).pack())
    assert sorted(tree.ids) == list(range(60)) and tree.parent[0] == -1 and (tree.parent[1:] < np.arange(1, 60)).all()
    near = np.linalg.norm(a[:, None] - a[None], axis=2)
    inside, total, weight = {0}, 0.0, 0.0
    while len(inside) < 60:  # Prim again, on all pairs
        rest = [j for j in range(60) if j not in inside]
        d, j = min((near[i, j], j) for i in inside for j in rest)
        inside.add(j)
        total += d
    weight = float(tree.edge[1:].sum())
    assert weight == pytest.approx(total)
    closed = 0
    for k, low, high in tree.walk(x):
        exact = x @ tree.x[k]
        assert (low <= exact).all() and (exact <= high).all()
        closed += int((high < np.quantile(exact, 0.99)).sum())
        top = high >= np.quantile(exact, 0.99)
        hn._rescore(x, tree.x[k], low, high, top)
    assert closed > 0.3 * 60 * 300


def test_large_entries():
    x = np.floor(256 * np.array([[1e15, -1e15], [3.0, 4.0], [1e12, 1.0]]))
    want = [[sum(int(p) * int(q) for p, q in zip(r, s)) for s in x] for r in x]
    clip = lambda v: min(max(v, hn.LONG.min), hn.LONG.max)
    assert [hn.inner(x, a).tolist() for a in x] == [[clip(v) for v in r] for r in want]
    assert hn.first_rows(np.array([hn.LONG.min, 5, 5, hn.LONG.max]), np.array([1, 9, 2, 3]), 3).tolist() == [3, 2, 1]
    many = np.random.default_rng(1).integers(0, 20, 5000)
    assert hn.first_rows(many, -np.arange(5000), 3).tolist() == np.lexsort((-np.arange(5000), -many))[:3].tolist()


@pytest.mark.parametrize("score", [0, 1, 7, 100, -1, -7, 12345])
def test_windows(score):
    low, high = hn.window(score)
    assert [s for s in range(-13000, 13000) if 50 * score <= 100 * s <= 95 * score] == list(range(low, high + 1))


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [2.0], 1)]) == []
    assert mined(spark, [(5, [1.0], 1)]) == []
