"""Folds by boundary keys; sorted codes of any number of values."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veritab.operators import prep
from veritab.operators import tuning as T


def sizes(df, cls):
    out = {}
    for r in df.groupBy(cls, "fold").count().collect():
        out.setdefault(r[cls], {})[r["fold"]] = r["count"]
    return out


@pytest.mark.parametrize("k", [2, 3, 7])
def test_exact_sizes_for_hot_keys_null_classes_and_repeated_rows(spark, k):
    base = spark.range(700).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"),
                                   F.when(F.col("id") % 5 > 0, F.col("id") % 2).alias("cls"), F.col("id").alias("x"))
    repeated = spark.range(400).select(F.lit(7).cast("long").alias("key"), F.lit(1).cast("long").alias("cls"), F.lit(1).cast("long").alias("x"))
    few = spark.createDataFrame([(None, 9, None), (None, 9, None), (None, 8, 1)], "key long, cls long, x long")
    df = base.unionByName(repeated).unionByName(few).repartition(5)
    out = T.boundary_folds(df, k, key="key", stratify="cls")
    assert out.columns == ["key", "cls", "x", "fold"] and out.count() == 1103
    assert out.drop("fold").exceptAll(df).count() == 0
    for own in sizes(out, "cls").values():
        counts = [own.get(f, 0) for f in range(k)]
        assert max(counts) - min(counts) <= 1
    one = T.boundary_folds(df, k)
    counts = [r["count"] for r in one.groupBy("fold").count().collect()]
    assert len(counts) == k and max(counts) - min(counts) <= 1


def test_no_rows_are_exchanged(spark):
    df = spark.range(500).select("id", (F.col("id") % 4).alias("cls"))
    plan = T.boundary_folds(df, 3, key="id", stratify="cls")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "Sort" not in plan
    assert T.boundary_folds(df.limit(0), 3, key="id", stratify="cls").count() == 0


def test_sorted_codes(spark):
    values = [None, "b", "a", "é", "Z", "a", "", "b", "😀"] + [f"v{i}" for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "value string").repartition(7)
    got = {r["value"]: r["code"] for r in prep.sorted_codes(df).collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}


def test_label_tables_and_their_inverse(spark):
    df = spark.createDataFrame([(i, None if i % 11 == 0 else i % 40) for i in range(200)], "i int, y int").repartition(3)
    encoded, table = prep.label_encode(df, "y", max_labels=10)
    assert encoded.columns == ["i", "y"] and {r["i"]: r["y"] for r in encoded.collect()} == {
        i: None if i % 11 == 0 else i % 40 for i in range(200)}
    back = prep.decode_by_table(encoded, "y", table, "own")
    assert back.columns == ["i", "y", "own"] and back.where("not (own <=> y)").count() == 0


def test_wide_slots_are_sorted_and_drop_first(spark, monkeypatch):
    monkeypatch.setattr(prep, "MAX_CATEGORIES", 5)
    monkeypatch.setattr(prep.fit_categories, "__defaults__", (5, "raise"))
    df = spark.createDataFrame([(i, None if i == 3 else f"c{i % 9}") for i in range(30)], "i int, c string")
    rows = {r["i"]: list(r["v"]) for r in prep.one_hot(df, ["c"]).select("i", vector_to_array("c_vec").alias("v")).collect()}
    assert all(v.index(1.0) == (9 if i == 3 else i % 9) and len(v) == 10 and sum(v) == 1 for i, v in rows.items())
    rows = {r["i"]: list(r["v"]) for r in prep.one_hot_drop_first(df, ["c"]).select("i", vector_to_array("c_vec").alias("v")).collect()}
    assert all(len(v) == 8 and ((i == 3 or i % 9 == 0) == (sum(v) == 0)) and (sum(v) == 0 or v.index(1.0) == i % 9 - 1)
               for i, v in rows.items())
