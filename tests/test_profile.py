import pytest
from pyspark.sql import functions as F

from veritab.operators import profile as P


def test_numeric_profile(halves):
    ref, cur = halves
    both = ref.unionByName(cur)
    rows = {r["column_name"]: r for r in P.profile_numeric(both, "target").collect()}
    frame = both.toPandas()
    for c in ("width", "height"):
        x, r = frame[c], rows[c]
        assert (r["min"], r["max"], r["missing"]) == (x.min(), x.max(), 0)
        for name, want in (("mean", x.mean()), ("median", x.median()), ("std", x.std()), ("skew", x.skew()),
                           ("corr_target", x.corr(frame["target"]))):
            assert r[name] == pytest.approx(want, abs=1e-9), (c, name)


def test_median_always_ends(spark):
    """Values over the whole range of doubles, infinities and heavy ties, on the path for large columns."""
    import numpy as np
    rng = np.random.default_rng(0)
    cols = {"log_uniform": 10.0 ** rng.uniform(-300, 300, 999), "signed": np.sign(rng.normal(size=999)) * 10.0 ** rng.uniform(-9, 9, 999),
            "with_inf": np.r_[rng.normal(size=996), np.inf, np.inf, -np.inf], "mostly_inf": np.r_[[np.inf] * 600, rng.normal(size=399)],
            "near": 1.0 + rng.integers(0, 3, 999) * 2.0 ** -52, "tiny": rng.integers(0, 50, 999) * 5e-324,
            "ties": np.r_[[2.0] * 700, rng.normal(size=299)]}
    rows = [tuple(float(cols[c][i]) for c in cols) for i in range(999)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    got = P.exact_medians(df, list(cols), collect_max=5, agg_max_rows=0)
    for c, v in cols.items():
        assert got[c] == float(np.median(v)), c


def test_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0, 1.0), (1.0, 6.0, 2.0), (1.0, 7.0, 3.0)], "c double, x double, t double")
    rows = {r["column_name"]: r for r in P.profile_numeric(df, "t").collect()}
    assert rows["c"]["skew"] == 0.0
    assert rows["c"]["corr_target"] is None       # constant: undefined, no error
    two = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert P.profile_numeric(two, None, ["x"]).first()["skew"] is None
    one = spark.createDataFrame([(1.0,)], "x double")
    assert P.profile_numeric(one, None, ["x"]).first()["std"] is None


def test_all_null_and_nan_column(spark):
    df = spark.createDataFrame([(None, float("nan")), (None, 1.0)], "a double, b double")
    rows = {r["column_name"]: r for r in P.profile_numeric(df, None, ["a", "b"]).collect()}
    assert rows["a"]["missing"] == 2 and rows["a"]["mean"] is None
    assert rows["b"]["missing"] == 1 and rows["b"]["mean"] == 1.0


def test_categorical_profile_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    r = P.profile_categorical(df, ["c"]).first()
    assert (r["n_distinct"], r["missing"], r["most_common"], r["most_common_count"]) == (2, 1, "a", 2)


def test_target_classes(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("z",)], "t string")
    r = P.profile_target_classes(df, "t").first()
    assert r["n_classes"] == 3
    assert (r["most_frequent"], r["most_frequent_count"]) == ("y", 2)
    assert (r["least_frequent"], r["least_frequent_count"]) == ("x", 1)


def test_histogram_equal_width_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in P.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 1, 2: 0, 3: 0, 4: 1}   # width 2; the last bin is closed
    c = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = P.histogram(c, "x", 2).orderBy("bin").collect()
    assert rows[0]["lower"] == 2.5 and rows[-1]["upper"] == 3.5
    assert sum(r["count"] for r in rows) == 2


def test_quality_counts_with_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, None), (2, "b")], "x int, s string")
    r = P.quality_counts(df).first()
    assert (r["row_count"], r["column_count"], r["missing_cells"], r["duplicate_rows"]) == (5, 2, 4, 2)
    assert r["missing_pct"] == pytest.approx(40.0)


def test_category_frequencies_one_side_only(spark):
    a = spark.createDataFrame([("a",), ("a",)], "c string")
    b = spark.createDataFrame([("b",)], "c string")
    rows = {r["value"]: (r["ref_freq"], r["cur_freq"]) for r in P.category_frequencies(a, b, "c").collect()}
    assert rows == {"a": (1.0, 0.0), "b": (0.0, 1.0)}


def test_dataset_summary_threshold(spark):
    ten = spark.createDataFrame([(float(i), i % 10) for i in range(30)], "x double, t int")
    eleven = spark.createDataFrame([(float(i), i % 11) for i in range(33)], "x double, t int")
    assert P.dataset_summary(ten, "t").first()["problem_type"] == "classification"
    assert P.dataset_summary(eleven, "t").first()["problem_type"] == "regression"


def test_empty_table(spark):
    e = spark.createDataFrame([], "x double, s string")
    assert P.quality_counts(e).first()["row_count"] == 0
    assert P.profile_numeric(e, None, ["x"]).first()["mean"] is None
    assert P.profile_categorical(e, ["s"]).first()["n_distinct"] == 0


def test_exact_median_bucket_path_matches_percentile(spark):
    from pyspark.sql import functions as F
    df = spark.range(20001).select(
        (F.col("id") % 97).cast("double").alias("ties"),
        F.when(F.col("id") % 500 == 0, F.lit(1e12)).otherwise(F.col("id") * 1e-3).alias("outliers"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.sin(F.col("id").cast("double"))).alias("holes"),
        F.lit(7.0).alias("const"))
    cols = df.columns
    want = df.agg(*[F.percentile(c, 0.5).alias(c) for c in cols]).first().asDict()
    got = P.exact_medians(df, cols, buckets=16, collect_max=50, agg_max_rows=0)
    assert got == want
    even = df.where(F.col("ties") != 96.0)   # drops 206 rows: an even count
    want2 = even.agg(*[F.percentile(c, 0.5).alias(c) for c in cols]).first().asDict()
    assert P.exact_medians(even, cols, buckets=8, collect_max=10, agg_max_rows=0) == want2
