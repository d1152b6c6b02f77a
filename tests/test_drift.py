import math
import statistics

import pytest
from pyspark.sql import functions as F

from veritab.operators import drift as D


def scores(df):
    return {r["column_name"]: r["drift_score"] for r in df.collect()}


def expected_scores(ref, cur):
    """The definition, in plain Python."""
    out = {}
    for c in ref.columns:
        (ma, sa), (mb, sb) = ((statistics.mean(v), statistics.stdev(v)) for v in
                              ([float(r[c]) for r in t.collect()] for t in (ref, cur)))
        out[c] = (abs(ma - mb) / (abs(ma) + 1e-10) + abs(sa - sb) / (abs(sa) + 1e-10)) / 2
    return out


def test_numeric_drift(halves):
    ref, cur = halves
    s = scores(D.numeric_drift(ref, cur))
    assert s == pytest.approx(expected_scores(ref, cur), abs=1e-9)


def test_dataset_drift(halves):
    ref, cur = halves
    r = D.dataset_drift(ref, cur).first()
    mean = statistics.mean(expected_scores(ref, cur).values())
    assert r["drift_score"] == pytest.approx(mean, abs=1e-9)
    assert r["drift_detected"] is (mean > 0.1)
    assert r["n_columns"] == 3


def _cat(spark, vals):
    return spark.createDataFrame([(v,) for v in vals], "c string")


def test_js_divergence_cases(spark):
    a = _cat(spark, ["a", "b"])
    b = _cat(spark, ["a", "b", "c", "c"])
    assert scores(D.categorical_drift(a, b))["c"] == pytest.approx(0.2157615532, abs=1e-9)
    assert scores(D.categorical_drift(_cat(spark, ["a"]), _cat(spark, ["b"])))["c"] == \
        pytest.approx(0.6931471782, abs=1e-9)
    assert scores(D.categorical_drift(a, _cat(spark, ["b", "a"])))["c"] == pytest.approx(0.0, abs=1e-15)


def test_js_symmetric_and_zero_on_self(spark):
    a = _cat(spark, ["x", "x", "y", None])
    b = _cat(spark, ["y", "z", "z"])
    ab = scores(D.categorical_drift(a, b))["c"]
    ba = scores(D.categorical_drift(b, a))["c"]
    assert ab == pytest.approx(ba, abs=1e-12)
    assert scores(D.categorical_drift(a, a))["c"] == pytest.approx(0.0, abs=1e-15)


def test_both_sides_empty_scores_zero(spark):
    e = spark.createDataFrame([], "c string")
    assert scores(D.categorical_drift(e, e))["c"] == 0.0


def test_single_row_std_gives_null_and_dataset_null(spark):
    one = spark.createDataFrame([(1.0,)], "x double")
    many = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert scores(D.numeric_drift(one, many))["x"] is None
    r = D.dataset_drift(one, many).first()
    assert r["drift_score"] is None and r["drift_detected"] is False


def test_no_common_column(spark):
    a = spark.createDataFrame([(1.0,)], "x double")
    b = spark.createDataFrame([(1.0,)], "y double")
    r = D.dataset_drift(a, b).first()
    assert r["drift_score"] == 0.0 and r["drift_detected"] is False and r["n_columns"] == 0


def test_routing_numeric_ref_string_cur_skipped(spark):
    a = spark.createDataFrame([(1.0, "u")], "x double, s string")
    b = spark.createDataFrame([("1.0", 2.0)], "x string, s double")
    rep = {r["column_name"]: r["column_type"] for r in D.drift_report(a, b).collect()}
    assert rep == {"s": "categorical"}


def test_nan_is_missing_in_numeric_drift(spark):
    a = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "x double")
    b = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert scores(D.numeric_drift(a, b))["x"] == pytest.approx(0.0, abs=1e-15)


def test_mean_shift(spark):
    df = spark.createDataFrame([("train", 10.0), ("train", 10.0), ("test", 13.0)], "split string, x double")
    r = D.mean_shift(df, ["x"]).first()
    assert r["shift_pct"] == pytest.approx(30.0, rel=1e-9)
    assert r["shifted"] is True
    assert D.mean_shift_detected(D.mean_shift(df, ["x"])).first()["drift_detected"] is True


def test_target_drift_data(spark, halves):
    ref, cur = halves
    d = D.target_drift_data(ref, cur, "width", bins=4)
    assert d["drift"].first()["column_type"] == "numeric"
    assert d["reference_histogram"].agg(F.sum("count")).first()[0] == 6
    a = spark.createDataFrame([("x",), ("y",)], "t string")
    b = spark.createDataFrame([("y",)], "t string")
    f = {r["value"]: (r["ref_freq"], r["cur_freq"]) for r in D.target_drift_data(a, b, "t")["frequencies"].collect()}
    assert f == {"x": (0.5, 0.0), "y": (0.5, 1.0)}


def test_a_reduced_reference_gives_the_same_report(spark, halves):
    ref, cur = (df.withColumn("word", F.concat(F.lit("w"), (F.col("target") + F.col("width").cast("int") % 3).cast("string"))) for df in halves)
    reduced = D.reduce_reference(ref, cur)
    rows = lambda df: sorted((r["column_name"], r["column_type"], r["drift_score"]) for r in df.collect())
    want = rows(D.drift_report(ref, cur))
    assert rows(D.drift_report(ref.limit(0), cur, reduced=reduced)) == want and len(want) == 4
