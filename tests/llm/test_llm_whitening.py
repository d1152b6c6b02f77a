import numpy as np
import pytest

from veritab.llm import eigen, whitening


def spectrum(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


CASES = {
    "random": np.cov(np.random.default_rng(1).normal(size=(40, 200))),
    "equal leading": spectrum([5, 5, 5, 3, 3, 1, 0.5, 0.1, 0.1, 0], 2),
    "nearly equal": spectrum([5, 5 - 1e-9, 5 - 2e-9, 4.9999, 1, 1e-8, 0, 0, 0, 0, 0], 3),
    "wide range": spectrum(10.0 ** -np.arange(12), 4),
    "diagonal": np.diag([3.0, 9, 9, 1, 2, 7, 0, 4, 8]),
    "blocks": np.kron(np.eye(4), [[2.0, 1], [1, 2]]),
    "tridiagonal": np.diag(np.full(21, 2.0)) + np.diag(np.full(20, -1.0), 1) + np.diag(np.full(20, -1.0), -1),
    "rank one": np.outer(np.arange(9.0), np.arange(9.0)),
    "zero": np.zeros((5, 5)), "one": np.array([[4.0]]), "two": np.array([[4.0, 1], [1, 3]]),
    "huge": spectrum(1e200 * np.arange(1.0, 12), 5), "tiny": spectrum(1e-200 * np.arange(1.0, 12), 6),
}


@pytest.mark.parametrize("case", CASES)
def test_eigenpairs_against_brute_force(case):
    m = CASES[case]
    values, vectors = eigen.leading_eigenpairs(m, 8)
    want = np.linalg.eigvalsh(m)[::-1][:8]
    norm = np.abs(want).max() or 1.0
    assert np.abs(values - want).max() <= 1e-13 * norm * len(m)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-11
    assert np.abs(m @ vectors - vectors * values).max() <= 1e-13 * norm * len(m)


def test_sturm_counts():
    d, off, _ = eigen.tridiagonalise(CASES["random"])
    own = np.linalg.eigvalsh(CASES["random"])
    at = np.concatenate([own[:-1] + np.diff(own) / 2, [own[0] - 1, own[-1] + 1]])
    assert eigen.sturm_count(d, off, at).tolist() == [int((own < a).sum()) for a in at]


def brute(rows):
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = x * n - sums
    centred = np.array([[float(e) / n for e in r] for r in y])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return n, (y * y).sum(axis=1).tolist(), centred, values[::-1], vectors[:, ::-1]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3, "x", 1.0) for i, v in rows],
                                 "vec_id long, embedding array<double>, n long, v string, whitened double")


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, rows[6][1])] + [(1000 + i, rows[8][1]) for i in range(120)]
    bad = [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [1.0] * 11 + [float("-inf")]), (404, [1.0]),
           (405, []), (406, [1e300] * 12)]
    out = whitening.whitened_components(table(spark, rows + bad)).collect()
    n, deviations, centred, values, vectors = brute(rows)
    assert len(out) == 8 * n and {r["component"] for r in out} == set(range(1, 9))
    got = {}
    for r in out:
        assert r["n"] == n and 0 <= r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    for (i, _), d, c in zip(rows, deviations, centred):
        for k in range(8):
            r = got[i, k + 1][0]
            assert r["deviation"] == d
            assert abs(r["whitened"]) == pytest.approx(abs(c @ vectors[:, k]) / np.sqrt(values[k]), abs=1e-8)
    for k in range(8):  # one sign for all rows
        want = [c @ vectors[:, k] / np.sqrt(values[k]) for c in centred]
        own = [got[i, k + 1][0]["whitened"] for i, _ in rows]
        assert abs(np.dot(want, own)) == pytest.approx(np.dot(want, want), rel=1e-9)


def test_degenerate_tables(spark):
    white = whitening.whitened_components
    assert white(table(spark, [])).count() == 0
    assert white(table(spark, [(1, None), (2, [float("nan")])])).count() == 0
    one = white(table(spark, [(1, [0.5, 2.0])])).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, None, None), (2, 0, None, None, None)]
    flat = white(table(spark, [(i, [float(i % 4), 7.0, 2.0 * (i % 4)]) for i in range(40)])).collect()
    assert all((r["whitened"] is None) == (r["component"] > 1) and r["identity_error"] < 1e-9 for r in flat)
    assert {round(r["explained"], 9) for r in flat if r["component"] == 1} == {1.0}


def test_deviation_at_any_size():
    rng = np.random.default_rng(3)
    for n, spread in ((10, 50), (10**8, 1000), (10**12, 10**4), (10**9, 2**55)):
        x = rng.integers(-spread, spread, (20, 6))
        sums = [int(rng.integers(-spread, spread)) * n + 17 for _ in range(6)]
        want = [sum((n * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
        got = whitening._deviations(x, n, sums).to_pylist()
        assert [None if g is None else int(g) for g in got] == [w if w < 10**38 else None for w in want]


def test_covariance_wider_than_a_tile(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=70) * np.linspace(3, 0.1, 70)).tolist()) for i in range(200)]
    out = whitening.whitened_components(table(spark, rows), components=3).collect()
    _, _, _, values, _ = brute(rows)
    assert {r["component"]: r["explained"] for r in out} == pytest.approx({k + 1: values[k] / values.sum() for k in range(3)})
    assert out[0]["identity_error"] < 1e-9
