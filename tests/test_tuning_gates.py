import pytest
from pyspark.sql import functions as F

from veritab.operators import gates as G
from veritab.operators import tuning as T


def test_grid_order_and_ranges(spark):
    grid = T.grid_dict("random_forest", T.DEFAULT_RANGES)
    assert grid["n_estimators"] == list(range(10, 101, 10))
    assert len(T.grid_combinations(grid)) == 10 * 8 * 5
    combos = T.grid_combinations({"b": [1, 2], "a": ["x", "y"]})
    assert combos[:2] == [{"a": "x", "b": 1}, {"a": "x", "b": 2}]
    assert len(T.grid_combinations(T.grid_dict("svm"))) == 6
    assert len(T.grid_combinations(T.grid_dict("neural_network"))) == 18
    assert T.param_grid(spark, "svm").count() == 6


def test_folds_cover_all_rows(spark):
    df = spark.range(300).withColumnRenamed("id", "k")
    f = T.assign_folds(df, 3, key="k")
    sizes = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(sizes) == 3 and sum(sizes) == 300 and min(sizes) > 70


def test_rank_ties_share_lowest(spark):
    s = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.7), (1, 0, 0.6), (1, 1, 0.6), (2, 0, 0.1), (2, 1, 0.1)],
                              "combo int, fold int, score double")
    r = {x["combo"]: x for x in T.rank_results(s).collect()}
    assert r[0]["rank_test_score"] == 1 and r[1]["rank_test_score"] == 1 and r[2]["rank_test_score"] == 3
    assert r[0]["std_test_score"] == pytest.approx(0.1)
    assert T.best_result(T.rank_results(s)).first()["combo"] == 0


def test_random_search_reproducible(spark):
    g = T.param_grid(spark, "neural_network")
    a = [r["combo"] for r in T.random_search(g, 5, seed=7).collect()]
    b = [r["combo"] for r in T.random_search(g, 5, seed=7).collect()]
    assert a == b and len(set(a)) == 5


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "name string, value double")


def test_requirements_directions_and_unknown(spark):
    m = _metrics(spark, [("Accuracy", 0.92), ("MSE", 3.0)])
    req = spark.createDataFrame([("Accuracy", 0.9), ("MSE", 2.0), ("Latency", 100.0)], "name string, threshold double")
    st = {r["name"]: r["status"] for r in G.check_requirements(m, req).collect()}
    assert st == {"Accuracy": "met", "MSE": "not-met", "Latency": "unknown"}


def test_evaluation_gate_defaults(spark):
    m = _metrics(spark, [("Accuracy", 0.95), ("Precision", 0.84), ("Other", 0.81)])
    g = {r["name"]: (r["target"], r["passed"]) for r in G.evaluation_gate(m).collect()}
    assert g == {"Accuracy": (0.9, True), "Precision": (0.85, False), "Other": (0.8, True)}
    assert G.gate_status(G.evaluation_gate(m)).first()["status"] == "Requirements Not Met"


def test_suite_and_details(spark):
    m = _metrics(spark, [("Accuracy", 0.9), ("Precision", 0.7), ("Recall", 0.9), ("F1 Score", 0.9)])
    r = G.performance_test(m).first()
    assert (r["passed"], r["total_cases"], r["failed_cases"]) == (False, 4, 1)
    assert r["details"] == "Ran 4 test cases with 1 failures."
    ok = G.performance_test(_metrics(spark, [("Accuracy", 1.0), ("Precision", 1.0), ("Recall", 1.0),
                                             ("F1 Score", 1.0)])).first()
    assert ok["details"] == "All 4 test cases passed successfully."
    s = G.suite_summary(G.performance_test(m).unionByName(
        G.performance_test(_metrics(spark, [("Accuracy", 1.0), ("Precision", 1.0), ("Recall", 1.0),
                                            ("F1 Score", 1.0)])))).first()
    assert (s["total"], s["passed"], s["failed"], s["status"]) == (2, 1, 1, "failed")


def test_fairness_gap(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", 0, 0), ("b", 1, 0), ("b", 0, 0)],
                               "g string, label int, prediction int")
    cases = {r["case"]: r["value"] for r in G.fairness_cases(df, "g").collect()}
    assert cases["selection_rate"] == pytest.approx(0.5)
    assert cases["true_positive_rate"] == pytest.approx(1.0)
    assert G.fairness_test(df, "g").first()["passed"] is False


def test_data_quality_and_drift_tests(spark, halves):
    ref, cur = halves
    assert G.drift_test(ref, ref).first()["passed"] is True
    r = G.drift_test(ref, cur).first()
    assert r["total_cases"] == 3 and r["failed_cases"] >= 1
    maps = spark.createDataFrame([({"a": 1}, float("nan")), ({"a": 1}, None)], "m map<string,int>, x double")
    own = {c["case"]: c["value"] for c in G.data_quality_cases(maps).collect()}
    assert own["duplicate_rows"] == 50.0 and own["missing:x"] == 100.0


def test_no_evidence_is_no_pass_and_direction(spark):
    empty = spark.createDataFrame([], "g string, label int, prediction int")
    assert G.data_quality_test(empty).first()["passed"] is False
    assert G.fairness_test(empty, "g").first()["passed"] is False
    one = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "g string, label int, prediction int")
    assert G.fairness_test(one, "g").first()["failed_cases"] == 1  # no positives: that rate is unknown
    errors = spark.createDataFrame([("RMSE", 50.0), ("Accuracy", 0.9)], "name string, value double")
    cases = {r["case"]: r["passed"] for r in G.performance_cases(errors, {"RMSE": 10.0}).collect()}
    assert cases["RMSE"] is False and cases["Accuracy"] is True


def test_null_classes_and_keys_stay(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 4 != 0, F.col("id")).alias("k"),
                                  F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("y"), "id")
    f = T.assign_folds(df, 3, key="k", stratify="y")
    assert f.count() == 1000 and f.columns == ["k", "y", "id", "fold"]
    for y, own in f.groupBy("y").pivot("fold").count().toPandas().set_index("y").iterrows():
        assert max(own) - min(own) <= 1, y
    plain = T.assign_folds(df, 3, key="k").where("k is null").groupBy("fold").count().collect()
    assert len(plain) == 3 and all(60 < r["count"] < 110 for r in plain)
    q = spark.createDataFrame([(1, None), (2, "a")], "x int, s string")
    dq = G.data_quality_test(q, max_missing_pct=10.0).first()
    assert dq["failed_cases"] == 1 and dq["total_cases"] == 3


def test_stratified_folds_exact_balance(spark):
    df = spark.range(1000).select(F.col("id").alias("k"),
                                  F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b")
                                  .otherwise("c").alias("y"))
    f = T.assign_folds(df, 3, key="k", stratify="y")
    assert f.count() == 1000 and f.select("k").distinct().count() == 1000
    sizes = {}
    for r in f.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    for y, c in sizes.items():
        assert len(c) == 3 and max(c) - min(c) <= 1, (y, c)


def test_fairness_compares_at_least_two_groups(spark):
    one = spark.createDataFrame([("a", 1, 1), ("a", 0, 0)], "g string, label int, prediction int")
    assert G.fairness_test(one, "g").first()["passed"] is False
    some = spark.createDataFrame([("a", 1, 1), ("b", 0, 0), ("c", 1, 1)], "g string, label int, prediction int")
    cases = {r["case"]: r for r in G.fairness_cases(some, "g").collect()}
    assert (cases["true_positive_rate"]["groups"], cases["true_positive_rate"]["left_out"]) == (2, 1)
    assert cases["true_positive_rate"]["passed"] and cases["selection_rate"]["left_out"] == 0
