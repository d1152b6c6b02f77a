"""Cost of a training pass: features once per row, batches without copies, tasks that grow with the rows."""

import math
import tracemalloc
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.operators import gradient as G
from veritab.operators import models as M
from veritab.plans import search as S
from veritab.session import FOREST_TASK_BYTES, fit_rows, spread_by_label, spread_for_iterations


def block(n=3000, width=5):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, width))
    return G.Block(x, None, (x[:, 0] > 0.2).astype(float), rng.integers(0, 3, n).astype("<i4"))


def read(net, width, rng, points=2):
    inputs = G.Inputs(rng.normal(size=width), 1 + rng.random(width), net.feature_map)
    size = inputs(np.zeros((1, width))).shape[1]
    shapes = net.shapes(size)
    return net, inputs, 0.1, 1.3, shapes, [net.start(size) + rng.normal(size=sum(map(math.prod, shapes))) for _ in range(points)]


@pytest.mark.parametrize("loss, classes", [("hinge", 2), ("hinge", 3), ("epsilon_insensitive", 1), ("squared", 1)])
@pytest.mark.parametrize("own_map", [None, G.RandomFourier(0.1, 20), G.TensorSketch(0.2, 0.5, 2, 30)])
def test_columns_equal_each_net_alone(loss, classes, own_map):
    rng, b = np.random.default_rng(8), block()
    nets = [G.Net(loss, classes=classes, feature_map=own_map, without_fold=f) for f in (None, 0, 2)]
    shared = [read(n, 5, rng) for n in nets]
    want = []
    for net, inputs, y_mean, y_std, shapes, points in shared:
        rows = b if net.without_fold is None else b.rows(b.fold != net.without_fold)
        for p in points:
            value, gradient = G.loss_and_gradient(net, G.unflatten(p, shapes), inputs(rows.x), None, (rows.y - y_mean) / y_std
                                                  if loss != "hinge" else rows.y, net.epsilon / y_std)
            want += [value, *gradient]
    if loss == "hinge":  # classes are no numbers to scale
        shared = [(*s[:2], 0.0, 1.0, *s[4:]) for s in shared]
        want = []
        for net, inputs, _, _, shapes, points in shared:
            rows = b if net.without_fold is None else b.rows(b.fold != net.without_fold)
            for p in points:
                value, gradient = G.loss_and_gradient(net, G.unflatten(p, shapes), inputs(rows.x), None, rows.y, net.epsilon)
                want += [value, *gradient]
    assert np.allclose(G._evaluate(b, shared), want, rtol=1e-9, atol=1e-8)


def test_features_of_a_row_are_computed_once_for_all_folds(monkeypatch):
    rng, b, rows = np.random.default_rng(9), block(), []
    first = G.Net("hinge", classes=2, feature_map=G.RandomFourier(0.1, 20))
    shared = [read(replace(first, without_fold=f), 5, rng) for f in (None, 0, 1, 2)]
    whole = G.RandomFourier.__call__
    monkeypatch.setattr(G.RandomFourier, "__call__", lambda self, x: rows.append(len(x)) or whole(self, x))
    G._evaluate(b, shared)
    assert sum(rows) == 3000


def test_cosine_to_the_last_digits():
    z = np.concatenate([np.linspace(-50, 50, 40_001), [0.0, math.pi, -math.pi]])
    assert np.abs(G.cosine(z.copy()) - np.cos(z)).max() < 1e-11


@pytest.mark.parametrize("coef0, degree, n", [(0.0, 2, 100), (0.7, 2, 100), (0.3, 3, 64), (0.7, 3, 8)])
def test_sketch_by_monomials_equals_the_one_by_transforms(coef0, degree, n):
    x = np.random.default_rng(10).normal(size=(50, 4))
    z = np.column_stack([math.sqrt(0.2) * x, np.full(50, math.sqrt(coef0))])
    rng, want = np.random.default_rng(42), 1.0
    for _ in range(degree):
        sketch = np.zeros((5, n))
        sketch[np.arange(5), rng.integers(0, n, 5)] = rng.choice([-1.0, 1.0], 5)
        want = want * np.fft.rfft(z @ sketch, axis=1)
    own = G.TensorSketch(0.2, coef0, degree, n)
    assert np.allclose(own(x), np.fft.irfft(want, n, axis=1))
    assert (own.basis(x)[1] is None) == (n == 8)


def test_blocks_of_a_batch_are_read_one_at_a_time():
    raw = [np.arange(100_000.0), np.ones(50_000), np.zeros(50_000, "<i4"), *(np.zeros(0),) * 3]
    batch = pa.RecordBatch.from_arrays([pa.array([r.tobytes()] * 40, pa.binary()) for r in raw],
                                       names=["x", "y", "fold", "pointer", "position", "value"])
    tracemalloc.start()
    own = next(G._unpacked(iter([batch]), 2, False))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert own.x[:2].tolist() == [[0.0, 1.0], [2.0, 3.0]] and peak < 5e6  # all 40 are 56 MB


def test_a_large_net_tries_the_whole_step_first():
    def steps(lean):
        s, tried = G.Search(G.Net("squared", (2,)), np.array([3.0, -2.0]), lean=lean), []
        while not s.done:
            points = s.points()
            tried.append(len(points))
            s.take([(float(p @ p * 0.5 + (p ** 4).sum()), p + 4 * p ** 3) for p in points])
        return tried, s.point
    (one, a), (three, b) = steps(True), steps(False)
    assert sum(one) < 0.7 * sum(three) and np.allclose(a, 0, atol=0.02) and np.allclose(b, 0, atol=0.02)


def test_tasks_grow_with_the_rows(spark):
    df = spark.range(1000)
    assert spread_for_iterations(df, 1000, 100).rdd.getNumPartitions() == 10
    assert spread_for_iterations(df, 1000, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_rows_of_a_task_follow_from_their_bytes():
    # a forest of 20 trees over five features: some 204 bytes a row in memory
    assert fit_rows("random_forest", 5, [{"n_estimators": 20}]) * 204 <= FOREST_TASK_BYTES < 200e6
    grid = [{"n_estimators": 20}, {"n_estimators": 200}]
    assert fit_rows("random_forest", 5, grid) == fit_rows("random_forest", 5, grid[1:]) < fit_rows("random_forest", 5, grid[:1]) / 4
    assert fit_rows("random_forest", 5, [{}]) == fit_rows("random_forest", 5, [{"n_estimators": 100}])


@pytest.mark.parametrize("family", ["svm", "neural_network"])
def test_blocks_of_a_net_task_are_few(family):
    # a Python worker holds them all: five features, the label and the fold
    assert fit_rows(family, 5, [{}]) * (5 * 8 + 8 + 4) < 16e6


def test_a_regression_forest_task_gets_its_own_range_of_labels(spark):
    # half of the labels are equal, some rows are there many times, some labels are missing
    df = spark.range(4000).select((F.col("id") % 10).cast("double").alias("__place"),
                                  F.when(F.col("id") % 2 == 0, 7.0).when(F.col("id") % 101 != 1, F.col("id") % 97 / 1).alias("a.y"))
    out = spread_by_label(df, "a.y", 4000, 500)
    assert out.columns == df.columns and sorted(out.collect(), key=str) == sorted(df.collect(), key=str)
    parts = [[-1.0 if r[1] is None else r[1] for r in p] for p in out.rdd.glom().collect() if p]
    assert len(parts) == 8 and max(map(len, parts)) < 1000
    assert all(p == sorted(p) for p in parts)
    assert all(a[-1] <= b[0] for a, b in zip(parts, parts[1:]))


def test_regression_forests_are_fitted_on_ranges_of_labels(spark, monkeypatch):
    df = spark.range(600).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 17 * 3.0).alias("y"))
    own, whole = [], M.train_random_forest
    monkeypatch.setattr(M, "train_random_forest", lambda d, *a, **k: own.append(d) or whole(d, *a, **k))
    model = M.train(df, ["a"], "y", "random_forest", "regression", {"n_estimators": 3, "max_depth": 5})
    parts = [[r["y"] for r in p] for p in own[0].rdd.glom().collect() if p]
    assert sum(map(len, parts)) == 600 and all(a[-1] <= b[0] for a, b in zip(parts, parts[1:]))
    assert model.transform(df).where(F.abs(F.col("prediction") - F.col("y")) > 6).count() == 0


def test_fits_of_a_search_do_not_move_the_rows_again(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
                                 (F.col("id") % 17 > 8).cast("int").alias("y"))
    plans, whole = [], M.train_random_forest
    monkeypatch.setattr(M, "train_random_forest", lambda own, *a, **k: plans.append(
        own._jdf.queryExecution().optimizedPlan().toString()) or whole(own, *a, **k))
    found = S.cross_validate(df, ["a", "b"], "y", "random_forest", "classification", [{"n_estimators": 2, "max_depth": 2}], 2)
    assert found.best_score > 0.8 and len(plans) == 2
    assert not any("Repartition" in p.split("InMemoryRelation")[0] for p in plans)


def test_predictions_with_missing_features_and_many_batches(spark):
    model = G.GradientModel(["a", "b"], [np.array([[1.0], [2.0]]), np.array([0.5])], "relu", "squared", 1, np.zeros(2), np.ones(2))
    rows = [(float(i), None if i % 7 == 0 else 1.0) for i in range(50)]
    out = model.transform(spark.createDataFrame(rows, "a double, b double").repartition(3)).collect()
    assert len(out) == 50
    assert all(r["prediction"] is None if r["b"] is None else r["prediction"] == r["a"] + 2.5 for r in out)
