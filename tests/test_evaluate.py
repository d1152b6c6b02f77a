import math
import random

import pytest
from pyspark.sql import functions as F

from veritab.operators import evaluate as E


def test_accuracy_and_macro(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    assert E.accuracy(df).first()[0] == 0.5
    pc = {r["class"]: r for r in E.per_class_metrics(df).collect()}
    # c is never predicted -> precision 0 (0/0), recall 0
    assert pc["c"]["precision"] == 0.0 and pc["c"]["recall"] == 0.0 and pc["c"]["f1"] == 0.0
    assert pc["b"]["precision"] == pytest.approx(1 / 3)
    m = E.macro_precision_recall_f1(df).first()
    assert m["precision"] == pytest.approx((1 + 1 / 3 + 0) / 3)
    assert m["recall"] == pytest.approx((0.5 + 1 + 0) / 3)


def test_prediction_never_labelled_counts_as_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1)], "label int, prediction int")
    pc = {r["class"]: r for r in E.per_class_metrics(df).collect()}
    assert set(pc) == {"0", "1"}
    assert pc["1"]["recall"] == 0.0


def test_confusion_matrix_square_with_zeros(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a")], "label string, prediction string")
    cm = {(r["label"], r["prediction"]): r["count"] for r in E.confusion_matrix(df).collect()}
    assert cm == {("a", "a"): 1, ("a", "b"): 1, ("b", "a"): 0, ("b", "b"): 0}


def test_regression_metrics_and_constant_label(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")
    m = {r["name"]: r["value"] for r in E.regression_metrics(df).collect()}
    assert m["MSE"] == 0.5 and m["MAE"] == 0.5 and m["RMSE"] == pytest.approx(0.5 ** 0.5)
    assert m["R² Score"] == pytest.approx(1 - 0.5 / 1.0)
    c = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "label double, prediction double")
    assert {r["name"]: r["value"] for r in E.regression_metrics(c).collect()}["R² Score"] == 1.0
    c2 = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "label double, prediction double")
    assert {r["name"]: r["value"] for r in E.regression_metrics(c2).collect()}["R² Score"] == 0.0


def test_roc_auc_perfect_and_ties(spark):
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, score double")
    assert E.roc_auc(perfect, "label", "score").first()[0] == pytest.approx(1.0)
    tied = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert E.roc_auc(tied, "label", "score").first()[0] == pytest.approx(0.5)
    none = spark.createDataFrame([(1, None), (1, float("nan"))], "label int, score double")
    assert E.roc_auc(none, "label", "score").first()[0] is None  # nothing to compare


def test_roc_is_exact_on_skewed_scores(spark):
    """Scores over many magnitudes and signs: every one is a point, the area is the rank statistic."""
    import numpy as np
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 20_000)
    s = np.round(np.sign(rng.normal(size=20_000)) * np.exp(rng.normal(size=20_000) * 9 + y), 12)
    s[:50] = 0.0
    df = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "label int, score double")
    order = np.argsort(s, kind="stable")
    values, place, count = np.unique(s[order], return_inverse=True, return_counts=True)
    ranks = (np.cumsum(count) - (count - 1) / 2)[place]
    pos = y[order] == 1
    want = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert E.roc_auc(df, "label", "score").first()[0] == pytest.approx(want, abs=1e-12)
    pts = E.roc_points(df, "label", "score").orderBy(F.desc("threshold")).collect()
    assert len(pts) == len(values) + 1 and (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)
    assert all(a["fpr"] <= b["fpr"] and a["tpr"] <= b["tpr"] for a, b in zip(pts, pts[1:]))
    assert E.roc_points(df, "label", "score", max_points=100).count() <= 101


def test_one_scan_for_all_class_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "label string, prediction string")
    m = {r["name"]: r["value"] for r in E.classification_metrics(df).collect()}
    assert m["Accuracy"] == pytest.approx(1 / 3) and m["Recall"] == pytest.approx(0.25)
    plan = E.classification_metrics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_undefined_areas_and_unknown_labels(spark):
    one = spark.createDataFrame([(1, 0.9), (1, 0.2)], "label int, score double")
    assert E.roc_auc(one, "label", "score").first()[0] is None
    rows = [(5, [0.1, 0.9]), (5, [0.3, 0.7]), (3, [0.8, 0.2]), (9, [0.5, 0.5]), (None, [0.5, 0.5]), (3, [None, 0.1])]
    df = spark.createDataFrame(rows, "label int, probability array<double>")
    pairs = {(r["class"], r["other"]): (r["auc"], r["n_class"], r["n_other"]) for r in E.class_pair_auc(df, "label", labels=[3, 5]).collect()}
    assert pairs == {(3, 5): (1.0, 1, 2), (5, 3): (1.0, 2, 2)}
    assert E.multiclass_auc(E.class_pair_auc(df.where("label = 5"), "label", labels=[3, 5])).first()[0] is None
    text = df.selectExpr("case label when 5 then 'b' when 3 then 'a' end as label", "probability")
    assert E.multiclass_auc(E.class_pair_auc(text, "label", labels=["a", "b"]), "classes").first()[0] == 1.0
    loss = E.log_loss(df.where("label in (3, 5)").where("probability[0] is not null"), "label", labels=[3, 5]).first()[0]
    assert loss == pytest.approx(-(math.log(0.9) + math.log(0.7) + math.log(0.8)) / 3)


def test_running_counts_of_scores_close_together(spark):
    """Scores a few units in the last place apart, of both signs, against plain counting."""
    rng = random.Random(1)
    scores = [rng.choice([1, -1]) * (1 - k * 2.0 ** -53) for k in range(40)] + [0.0, 5e-324, -5e-324, 1e308, -1e308, 0.99999, 0.5, 0.5]
    rows = [(s, rng.random() < 0.5) for s in scores * 3]
    df = spark.createDataFrame([(s, int(y)) for s, y in rows], "score double, label int").repartition(3)
    got = sorted(map(tuple, E._score_counts(df, "label", "score", 1).select("s", "cum_pos", "cum_neg").collect()))
    want = sorted((s, sum(y for t, y in rows if t >= s), sum(not y for t, y in rows if t >= s)) for s in set(scores))
    assert got == want
