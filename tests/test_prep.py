import pytest
from pyspark.sql import functions as F

from veritab.operators import prep
from veritab.plans.prepare import prepare
from veritab.sources.tables import load_table

from conftest import SF_SMALL


def test_drop_nulls_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (2.0, None)], "x double, s string")
    assert prep.drop_nulls(df).count() == 1


def test_standardize_population_std_and_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    rows = prep.standardize(df, ["x", "c"]).collect()
    assert [r["x"] for r in rows] == [-1.0, 1.0, None]
    assert [r["c"] for r in rows] == [0.0, 0.0, 0.0]


def test_one_hot_names_order_nan_and_unseen(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, c string")
    out = prep.one_hot(df, ["c"])
    assert out.columns == ["k", "c_a", "c_b", "c_nan"]
    assert [tuple(r)[1:] for r in out.orderBy("k").collect()] == [(0.0, 1.0, 0.0), (1.0, 0.0, 0.0),
                                                                 (0.0, 0.0, 1.0)]
    cats = prep.fit_categories(df, ["c"])
    unseen = spark.createDataFrame([(9, "zzz")], "k int, c string")
    assert tuple(prep.apply_one_hot(unseen, cats).first())[1:] == (0.0, 0.0, 0.0)


def test_one_hot_drop_first(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, c string")
    out = prep.one_hot_drop_first(df, ["c"])
    assert out.columns == ["k", "c_b"]
    assert [r["c_b"] for r in out.orderBy("k").collect()] == [1.0, 0.0, 0.0]


def test_one_hot_guard(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        prep.one_hot(df, ["c"], max_categories=10)


def test_label_encode_sorted_natural_order(spark):
    df = spark.createDataFrame([(10,), (2,), (2,), (7,)], "y int")
    out, labels = prep.label_encode(df, "y")
    assert labels == [2, 7, 10]
    assert [r["y"] for r in out.collect()] == [2, 0, 0, 1]


def test_split_disjoint_and_complete(spark):
    o = load_table(spark, SF_SMALL, "orders").select("o_orderkey")
    s = prep.train_test_split(o, 0.8, key="o_orderkey")
    n = o.count()
    counts = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["train"] + counts["test"] == n
    assert s.select("o_orderkey").distinct().count() == n
    # reproducible
    again = prep.train_test_split(o, 0.8, key="o_orderkey")
    assert s.exceptAll(again).count() == 0


def test_exact_split_sizes(spark):
    o = load_table(spark, SF_SMALL, "orders").select("o_orderkey")
    n = o.count()
    for ratio in (0.8, 0.75, 0.5):
        s = prep.train_test_split(o, ratio, key="o_orderkey", exact=True)
        assert s.where(F.col("split") == "train").count() == prep.train_size_for(n, ratio)
        assert s.count() == n


def test_exact_split_with_duplicate_rows(spark):
    df = spark.createDataFrame([(1,)] * 7 + [(2,)] * 3, "v int")
    s = prep.train_test_split(df, 0.8, exact=True)
    assert s.where(F.col("split") == "train").count() == 8


def test_prepare_stats_and_unknown_step(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (2.0, "b", "y"), (None, "a", "x"), (4.0, "b", "y")],
                               "f double, c string, t string")
    p = prepare(df, ratio=0.5, exact=True)
    st = p.stats.first()
    assert (st["rows"], st["columns"], st["train_size"] + st["test_size"]) == (4, 3, 3)
    assert p.features == ["f", "c_a", "c_b"]
    assert p.task_labels == ["x", "y"]
    with pytest.raises(ValueError):
        prepare(df, steps=("feature_selection",))


def test_prepare_fit_on_train(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "f double, t int")
    p = prepare(df, steps=("normalize",), fit_on="train", key=None)
    tr = p.data.where(F.col("split") == "train").agg(F.avg("f")).first()[0]
    assert tr == pytest.approx(0.0, abs=1e-9)


def test_label_inverse(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "y string")
    enc, labels = prep.label_encode(df, "y", "idx")
    back = enc.select("y", prep.inverse_label_expr(F.col("idx"), labels).alias("back")).collect()
    assert all(r["y"] == r["back"] for r in back)


def test_wide_columns_become_sparse_vectors(spark):
    from pyspark.ml.functions import vector_to_array
    from veritab.plans.prepare import prepare
    df = spark.range(400).select(F.concat(F.lit("v."), (F.col("id") % 150).cast("string")).alias("a.wide"),
                                 F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), (F.col("id") % 3).cast("string"))).alias("narrow"),
                                 F.col("id").cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    p = prepare(df, ("normalize", "one_hot_encode"), target="y", max_categories=100)
    assert p.features == ["x", "narrow_n1", "narrow_n2", "narrow_nan", "a.wide_vec"]
    rows = p.data.select(vector_to_array("`a.wide_vec`").alias("v"), "x").collect()
    assert len(rows) == 400 and all(len(r["v"]) == 151 and sum(r["v"]) == 1.0 for r in rows)
    slot = {}
    for r in sorted(rows, key=lambda r: r["x"]):
        slot.setdefault(len(slot) if len(slot) < 150 else None, r["v"].index(1.0))
    assert len({r["v"].index(1.0) for r in rows}) == 150 and 150 not in {r["v"].index(1.0) for r in rows}
    from veritab.operators.models import train
    model = train(p.data.where("split = 'train'"), p.features, "y", "random_forest", "classification", {"n_estimators": 3})
    assert model.transform(p.data.where("split = 'test'")).where("prediction is null").count() == 0


def test_null_next_to_the_text_nan(spark):
    df = spark.createDataFrame([("nan",), (None,), ("a",)], "c string")
    assert prep.one_hot(df, ["c"]).columns == ["c_a", "c_nan", "c_nan_"]
