"""The training engine: gradients, L-BFGS, shared passes, kernels, calibration, wide columns."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veritab.operators import gradient as G
from veritab.operators import models as M
from veritab.operators import prep
from veritab.plans import search as S


def random_sparse(rng, n, slots):
    size = rng.integers(0, 4, n)
    return G.Sparse(np.concatenate([[0], np.cumsum(size)]), rng.integers(0, slots, size.sum()), rng.normal(size=size.sum()))


@pytest.mark.parametrize("loss, classes", [("squared", 1), ("epsilon_insensitive", 1), ("hinge", 2), ("hinge", 4), ("softmax", 3)])
@pytest.mark.parametrize("hidden, activation", [((), "relu"), ((5,), "tanh"), ((6, 3), "logistic"), ((4,), "identity")])
def test_gradients_against_differences(loss, classes, hidden, activation):
    rng = np.random.default_rng(1)
    x, wide = rng.normal(size=(9, 3)), random_sparse(rng, 9, 5)
    y = rng.normal(size=9) if classes == 1 else rng.integers(0, classes, 9).astype(float)
    net = G.Net(loss, hidden, activation, classes)
    shapes = net.shapes(8)
    w = rng.normal(size=sum(int(np.prod(s)) for s in shapes))
    value, gradient = G.loss_and_gradient(net, G.unflatten(w, shapes), x, wide, y, 0.1)
    dense = np.zeros((9, 5))
    np.add.at(dense, (np.repeat(np.arange(9), np.diff(wide.pointer)), wide.index), wide.value)
    same, _ = G.loss_and_gradient(net, G.unflatten(w, shapes), np.hstack([x, dense]), None, y, 0.1)
    assert value == pytest.approx(same)
    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-6
        up, _ = G.loss_and_gradient(net, G.unflatten(w + e, shapes), x, wide, y, 0.1)
        down, _ = G.loss_and_gradient(net, G.unflatten(w - e, shapes), x, wide, y, 0.1)
        assert gradient[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_sparse_rows():
    rng = np.random.default_rng(2)
    s = random_sparse(rng, 20, 6)
    keep = rng.random(20) < 0.5
    w = rng.normal(size=(6, 3))
    assert np.allclose((s @ w)[keep], s.rows(keep) @ w)
    delta = rng.normal(size=(20, 3))
    dense = np.zeros((20, 6))
    np.add.at(dense, (np.repeat(np.arange(20), np.diff(s.pointer)), s.index), s.value)
    assert np.allclose(s @ w, dense @ w) and np.allclose(s.transposed_times(delta, 6), dense.T @ delta)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    rows = [(*map(float, r), float(3 * r[0] - 2 * r[1] + 0.1 * e), int(r[0] + 0.5 * r[1] + 0.4 * e > 0), float(r[2] * r[3] > 0))
            for r, e in zip(x, rng.normal(size=600))]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, line double, side int, product double").repartition(3)


FEATURES = ["a", "b", "c", "d"]


def test_linear_fit_equals_the_closed_form(points):
    model = G.GradientModel.fit(points, FEATURES, "line", hidden=(), alpha=1.0, tol=1e-14)
    p = points.toPandas()
    x, y = p[FEATURES].to_numpy(), p["line"].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    t = (y - y.mean()) / y.std()
    want = np.linalg.solve(z.T @ z + np.eye(4), z.T @ t)
    assert np.allclose(model.weights[0][:, 0], want, atol=1e-6) and len(model.history) < 40


def test_nets_together_equal_nets_alone(points, monkeypatch):
    folded = points.withColumn("fold", F.pmod(F.xxhash64("a"), F.lit(3)).cast("int"))
    nets = [G.Net("softmax", (5,), "tanh", 2, 1e-3, max_iter=15, without_fold=f) for f in (None, 0, 2)]
    nets += [G.Net("hinge", classes=2, penalty=0.5, raw_penalty=True, max_iter=15, without_fold=1)]
    calls = []
    whole = G.Table.sum
    monkeypatch.setattr(G.Table, "sum", lambda self, *a, **b: calls.append(1) or whole(self, *a, **b))
    table = G.pack(folded, FEATURES, "side", fold="fold", folds=3)
    together = G.fit_nets(table, nets)
    shared = len(calls) - 2
    table.close()
    alone = []
    for net in nets:
        rows = folded if net.without_fold is None else folded.where(F.col("fold") != net.without_fold)
        own = G.pack(rows, FEATURES, "side")
        del calls[:]
        alone += G.fit_nets(own, [replace(net, without_fold=None)])
        assert len(calls) <= shared
        own.close()
    for a, b in zip(together, alone):
        assert a.history == pytest.approx(b.history, rel=1e-6)
        assert all(np.allclose(v, w, atol=1e-4) for v, w in zip(a.weights, b.weights))


def accuracy(model, df, label):
    return model.transform(df).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


def test_kernels_learn_what_a_line_can_not(points):
    assert accuracy(M.train_svm(points, FEATURES, "product", kernel="linear", probability=False), points, "product") < 0.65
    # a sigmoid kernel suits products less than the others
    for kernel, more, least in (("poly", {"degree": 2}, 0.9), ("rbf", {"n_components": 200}, 0.85),
                                ("sigmoid", {"coef0": 0.5, "n_components": 200}, 0.75)):
        model = M.train_svm(points, FEATURES, "product", kernel=kernel, C=10.0, probability=False, max_iter=50, **more)
        assert accuracy(model, points, "product") > least, kernel
    again = G.GradientModel.from_dict(model.to_dict())
    assert accuracy(again, points, "product") == accuracy(model, points, "product")


def test_feature_maps_approach_their_kernels():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 5))
    near = lambda z, k: np.abs(z @ z.T - k).mean()
    dist = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert near(G.RandomFourier(0.2, 4000)(x), np.exp(-0.2 * dist)) < 0.03
    poly = (0.3 * x @ x.T + 1) ** 2
    assert near(G.TensorSketch(0.3, 1.0, 2, 4096)(x), poly) < 0.05 * np.abs(poly).mean()
    sigmoid = np.tanh(0.05 * x @ x.T)
    assert near(G.Landmarks(x.tolist(), 0.05)(x), sigmoid) < 0.02


def test_calibration_against_brute_force(points):
    table = G.pack(points, FEATURES, "side", folds=3)
    nets = [G.Net("hinge", classes=2, penalty=1.0, raw_penalty=True, without_fold=f) for f in range(3)]
    models = G.fit_nets(table, nets)
    (a, b), = G.fit_platt(table, models)
    m, y = [], []
    for row in table.blocks.toPandas().to_dict("records"):
        labels, folds = np.frombuffer(row["y"], "<f8"), np.frombuffer(row["fold"], "<i4")
        x = np.frombuffer(row["x"], "<f8").reshape(len(labels), 4)
        for f in range(3):
            m.append(models[f].margins(x[folds == f])[:, 0])
            y.append(labels[folds == f])
    table.close()
    m, y = np.concatenate(m), np.concatenate(y)
    t = np.where(y == 1, ((y == 1).sum() + 1) / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    loss = lambda a, b: (np.logaddexp(0, a * m + b) - (1 - t) * (a * m + b)).sum()
    steps = [loss(a + i, b + j) for i in (-1e-3, 0, 1e-3) for j in (-1e-3, 0, 1e-3)]
    assert a < 0 and min(steps) == steps[4]


def test_probabilities_are_calibrated(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 2))
    chance = 1 / (1 + np.exp(-1.5 * x[:, 0]))
    rows = [(float(a), float(b), int(u < c)) for (a, b), c, u in zip(x, chance, rng.random(6000))]
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(3)
    model = M.train_svm(df, ["a", "b"], "y", kernel="linear")
    bins = (model.transform(df).select("y", vector_to_array("probability")[1].alias("p"))
            .groupBy(F.floor(F.col("p") * 10)).agg(F.avg("y").alias("y"), F.avg("p").alias("p"), F.count("*").alias("n")).collect())
    assert sum(abs(r["y"] - r["p"]) * r["n"] for r in bins) / 6000 < 0.03
    assert all(abs(r["y"] - r["p"]) < 0.08 for r in bins if r["n"] > 200)


@pytest.mark.parametrize("kind, grid", [("neural_network", {"hidden_layer_sizes": [[4], [3, 3]], "activation": ["relu", "tanh"],
                                                            "alpha": [0.001], "max_iter": [12]}),
                                        ("svm", {"C": [0.5, 5], "kernel": ["linear", "rbf"], "n_components": [20], "max_iter": [20]})])
def test_grid_scores_equal_single_fits(points, monkeypatch, kind, grid):
    calls = []
    whole = G.Table.sum
    monkeypatch.setattr(G.Table, "sum", lambda self, *a, **b: calls.append(1) or whole(self, *a, **b))
    own = points.withColumn("key", F.xxhash64("a"))
    objective = "f1" if kind == "svm" else "accuracy"
    found = S.cross_validate(own, FEATURES, "side", kind, "classification", S.grid_combinations(grid), 3, "key", objective=objective)
    assert len(calls) < 30  # twelve fits in the passes of one
    got = {(r["combo"], r["fold"]): r["score"] for r in found.scores.collect()}
    assert len(got) == 12
    data = S.boundary_folds(own, 3, "key", 42, stratify="side").persist()
    for (combo, fold), score in list(got.items())[::5]:
        extra = {"probability": False} if kind == "svm" else {}
        model = M.train(data.where(F.col("fold") != fold), FEATURES, "side", kind, "classification",
                        S.grid_combinations(grid)[combo] | extra)
        want = S.score_predictions(model.transform(data.where(F.col("fold") == fold)), "side", objective)
        assert score == pytest.approx(want, abs=0.011)  # two rows: sums of floats in another order


def test_auc_and_log_loss_follow_the_models_labels(spark, points):
    own = points.withColumn("label", F.col("side") + 1)
    model = M.train(own, FEATURES, "label", "random_forest", "classification", {"n_estimators": 5})
    out = model.transform(own)
    labels = M.label_order(model)
    assert labels == [1.0, 2.0] and S.score_predictions(out, "label", "auc", labels) > 0.95
    assert -0.4 < S.score_predictions(out, "label", "log_loss", labels) < 0
    found = S.cross_validate(own, FEATURES, "label", "random_forest", "classification", [{"n_estimators": 3}], 3, objective="auc")
    assert 0.8 < found.best_score <= 1
    assert S.score_predictions(out.where("label = 1"), "label", "auc", labels) is None


def test_wide_columns_in_every_family(spark):
    df = spark.range(900).select((F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("v"), (F.col("id") % 60).cast("string")).alias("w"),
                                 ((F.col("id") % 60) < 30).cast("int").alias("y"))
    data = prep.one_hot_vector(df, ["w"]).withColumn("z", F.col("y") * 4.0 + F.col("x"))
    for kind, task, label, params in (
            ("svm", "classification", "y", {"kernel": "linear", "C": 10.0, "max_iter": 25}),
            ("svm", "classification", "y", {"kernel": "rbf", "C": 10.0, "max_iter": 25}),
            ("svm", "regression", "z", {"kernel": "linear", "C": 10.0, "max_iter": 40}),
            ("neural_network", "classification", "y", {"hidden": (6,), "activation": "relu", "max_iter": 25}),
            ("neural_network", "classification", "y", {"hidden": (6,), "activation": "logistic"}),
            ("neural_network", "regression", "z", {"hidden": (6,), "activation": "tanh", "max_iter": 40})):
        out = M.train(data, ["x", "w_vec"], label, kind, task, params).transform(data)
        if task == "classification":
            assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.95, (kind, params)
        else:
            assert out.agg(F.avg(F.abs(F.col("prediction") - F.col("z")))).first()[0] < 0.5, (kind, params)
