"""Forests of a search, grown together: the parts against plain versions, and whole searches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.operators import forests as G
from veritab.operators import models as M
from veritab.operators import tuning as T
from veritab.plans import search as S

COMBOS = [{"n_estimators": n, "max_depth": d} for d in (2, 5) for n in (3, 7)]


def rows(spark, n=900):
    """Numbers with and without repeats, rows that are there three times, and labels with some noise."""
    x = F.col("id") % 300
    return spark.range(n).select((x * 7919 % 1013 / 10.0).alias("a.x"), (x % 5).alias("b"), (x * 31 % 47).cast("double").alias("c"),
                                 F.when((x * 7919 % 1013 > 500) & (x % 5 > 1), 1).when(x % 47 == 3, 1).otherwise(0).alias("y"))


def test_weights_are_poisson():
    p = np.bincount(G.WEIGHTS, minlength=9) / len(G.WEIGHTS)
    assert np.allclose(p[:4], [0.36788, 0.36788, 0.18394, 0.06131], atol=2e-5) and abs((p * np.arange(9)).sum() - 1) < 1e-4
    a, b = G.row_weights(42, 0, 5, 40_000), G.row_weights(42, 1, 5, 40_000)
    assert (a == G.row_weights(42, 0, 5, 40_000)).all() and abs(np.corrcoef(a, b)[0, 1]) < 0.02


def test_summary_keeps_few_values_and_halves_many():
    values, n = G.summary(np.repeat([3.0, 1.0, 2.0], [5, 1, 9]))
    assert values.tolist() == [1, 2, 3] and n.tolist() == [1, 9, 5]
    x = np.random.default_rng(1).normal(size=60_000) ** 3
    parts = [G.summary(p) for p in np.split(x, 6)]
    values, n = G.summary(*map(np.concatenate, zip(*parts)))
    assert len(values) <= G.POINTS and n.sum() == pytest.approx(60_000)
    share = [(x <= t).mean() * 32 for t in G.thresholds(values, n)]
    assert len(share) == 31 and np.allclose(share, np.arange(1, 32), atol=0.15)


def test_thresholds_lie_between_values():
    assert G.thresholds(np.array([4.0, 1.0, 2.0]), np.ones(3)).tolist() == [1.5, 3.0]
    assert len(G.thresholds(np.array([7.0]), np.ones(1))) == 0
    heavy = np.arange(100.0), np.where(np.arange(100) == 50, 1e6, 1.0)
    own = G.thresholds(*heavy)
    assert 1 <= len(own) <= 31 and {49.5, 50.5} & set(own.tolist())


def test_counts_equal_a_loop_over_rows():
    rng, n = np.random.default_rng(3), 500
    x, y = rng.integers(0, 6, (2, 3, n)).astype(np.uint8), rng.integers(0, 2, n).astype("<u2")
    block = G.Block(9, x, y, np.array([0, 200, n]))
    feature, cut = [np.array([1])], [np.array([2], np.uint8)]
    size = 2 * 2 * G.BINS * 3
    shared = [(v, 42, 4, feature, cut, np.array([0, 2 * G.BINS]), 2, v * size) for v in (0, 1)]
    total = np.zeros(2 * size)
    G._count(block, (2, shared), total)
    want, w = np.zeros((2, 3, 2, 2, G.BINS)), G.row_weights(42, 4, 9, n)
    for v in (0, 1):
        for r in range(n):
            if (r < 200) != (v == 0):
                for j in range(3):
                    want[v, j, int(x[v, 1, r] > 2), y[r], x[v, j, r]] += w[r]
    assert (total.reshape(want.shape) == want).all()


def test_a_level_takes_the_best_split_of_the_chosen_features():
    found = np.zeros((2, 1, 2, G.BINS))
    found[0, 0, 0, :3], found[0, 0, 1, 3:6] = 10, 10  # feature 0 parts the classes at bin 2
    found[1, 0, :, :2] = 15
    tree = G.Tree(0, 0, 1, 1, 2, 4)
    tree.grow(found, np.array([31, 31]))
    assert tree.feature[0].tolist() == [0] and tree.cut[0].tolist() == [2] and tree.counts[1].tolist() == [[30, 0], [0, 30]]
    assert not len(tree.open)  # both children are pure
    large = G.Tree(0, 0, 1, 31, 2, 4)  # no child may have fewer than 31 of the 60 rows
    large.grow(found, np.array([31, 31]))
    assert not large.split[0].any() and large.leaves(4).tolist() == [[0.5, 0.5]] * 2


def test_leaves_that_agree_are_one():
    tree = G.Tree(0, 0, 1, 1, 1, 2, split=[np.array([True]), np.array([True, True])],
                  counts=[np.array([[9., 9.]]), np.array([[8., 2.], [1., 7.]]), np.array([[5., 0.], [3., 2.], [1., 0.], [0., 7.]])],
                  feature=[np.array([0])] * 2, cut=[np.array([0])] * 2)
    assert tree.leaves(2).tolist() == [[0.8, 0.2], [0.8, 0.2], [1, 0], [0, 1]]
    assert tree.leaves(1).tolist() == [[0.8, 0.2], [0.125, 0.875]]


def test_a_smaller_forest_alone_equals_its_part_of_the_larger(spark):
    data = T.boundary_folds(rows(spark), 3, stratify="y")
    table = G.pack(data, ["a.x", "b", "c"], "y", 3, 2, 900)
    plans = [G.Forest(c["n_estimators"], c["max_depth"], 1, 42, f) for c in COMBOS for f in range(3)]
    _, shared = G.fit_forests(table, plans)
    for plan, model in list(zip(plans, shared))[:5]:
        _, alone = G.fit_forests(table, [plan])
        assert all(np.array_equal(a, b) for a, b in zip(model.leaves, alone[0].leaves))
    assert table.sizes.sum() == 900 and len(table.bounds[0][1]) == 4
    table.close()


@pytest.mark.parametrize("objective", ["accuracy", "f1", "auc", "log_loss"])
def test_scores_are_those_of_spark_forests(spark, monkeypatch, objective):
    df = rows(spark, 6000)
    found = S.cross_validate(df, ["a.x", "b", "c"], "y", "random_forest", "classification", COMBOS, 3, objective=objective)
    monkeypatch.setattr(S, "_forest_together", lambda *a: False)
    plain = S.cross_validate(df, ["a.x", "b", "c"], "y", "random_forest", "classification", COMBOS, 3, objective=objective)
    a, b = ({(r["combo"], r["fold"]): r["score"] for r in s.scores.collect()} for s in (found, plain))
    assert set(a) == set(b) and len(a) == 12
    mean = [np.mean(list(s.values())) for s in (a, b)]
    assert abs(mean[0] - mean[1]) < 0.06


def test_no_forest_of_a_search_is_fitted_on_its_own(spark, monkeypatch):
    monkeypatch.setattr(M, "train_random_forest", lambda *a, **k: pytest.fail("a fit of its own"))
    found = S.cross_validate(rows(spark), ["a.x", "b", "c"], "y", "random_forest", "classification",
                             [{"n_estimators": 3, "max_depth": d, "min_samples_split": 4} for d in (2, 4)], 2, objective="auc")
    assert found.best_score > 0.8


def test_own_labels_and_several_classes(spark):
    df = rows(spark, 1200).withColumn("y", F.when(F.col("b") == 4, 9.0).otherwise(F.col("y") + 3.0))
    for objective in ("accuracy", "auc"):
        found = S.cross_validate(df, ["a.x", "b", "c"], "y", "random_forest", "classification", COMBOS[2:], 3, objective=objective)
        assert 0.8 < found.best_score <= 1


def test_missing_features_and_labels_are_errors(spark):
    for hole in ("c", "y"):
        df = rows(spark).withColumn(hole, F.when(F.col("b") != 2, F.col(hole)))
        with pytest.raises(ValueError, match="missing values|without a label"):
            S.cross_validate(df, ["a.x", "b", "c"], "y", "random_forest", "classification", COMBOS[:2], 3)


def test_folds_from_kept_places_are_the_same(spark):
    df = rows(spark)
    kept = T.boundary_folds(T.fold_places(df, None, 42, "y"), 4, stratify="y", placed=True)
    assert kept.columns == [*df.columns, "fold"]
    assert sorted(kept.collect()) == sorted(T.boundary_folds(df, 4, stratify="y").collect())


def test_the_best_mean_needs_no_fit_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(M, "train_random_forest", lambda *a, **k: pytest.fail("a fit of its own"))
    found = S.grid_search(rows(spark), ["a.x", "b", "c"], "y", "random_forest", "classification",
                          {"n_estimators": [2, 4], "max_depth": [2, 4]}, 3)
    means = [r["mean_test_score"] for r in found.results.collect()]
    assert len(means) == 4 and S.cross_val_score(found) == pytest.approx(max(means))


def test_areas_of_a_random_search_come_from_shared_passes(spark, monkeypatch):
    monkeypatch.setattr(M, "train_random_forest", lambda *a, **k: pytest.fail("a fit of its own"))
    found = S.random_search(rows(spark), ["a.x", "b", "c"], "y", "random_forest", "classification", 2,
                            {"n_estimators": [2, 4], "max_depth": [2, 4]}, 3, objective="auc")
    scores = found.scores.collect()
    assert len(scores) == 6 and all(0.7 < r["score"] <= 1 for r in scores)
