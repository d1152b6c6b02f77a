import os
import tempfile

import pytest
from pyspark.sql import functions as F

from veritab.sources import readers as R
from veritab.sources import storage as S
from veritab.sources.synthetic import PRESETS, synthetic_table


@pytest.fixture()
def data_dir():
    d = tempfile.mkdtemp(prefix="veritab-src-")
    with open(os.path.join(d, "wine_quality.csv"), "w") as fh:
        fh.write("fixed_acidity,quality,kind,flag\n7.4,5,red,True\nNA,6,white,False\n7.8,,N/A,true\n")
    with open(os.path.join(d, "customer_churn.csv"), "w") as fh:
        fh.write("customer_id,age,churn\n1,40,Yes\n2,51,No\n")
    with open(os.path.join(d, "records.json"), "w") as fh:
        fh.write('[{"a": 1, "b": "x"}, {"a": 2, "b": null}]')
    return d


def test_name_resolution(spark, data_dir):
    for root in (data_dir, "file://" + data_dir):
        for name, want in (("Wine Quality Dataset", "wine_quality.csv"), ("wine_quality.csv", "wine_quality.csv"),
                           ("churn", "customer_churn.csv"), ("Records", "records.json")):
            assert R.resolve_dataset(spark, name, root).endswith("/" + want)
        with pytest.raises(FileNotFoundError):
            R.resolve_dataset(spark, "mnist", root)
    assert R.read_dataset(spark, f"file://{data_dir}/customer_churn.csv", "/nowhere").count() == 2


def test_csv_quotes_line_breaks_and_declared_schema(spark, data_dir):
    with open(os.path.join(data_dir, "notes.csv"), "w") as fh:
        fh.write('id,note\n1,"He said ""hi"", ok"\n2,"two\nlines"\nNA,n/a\n')
    rows = [tuple(r) for r in R.read_dataset(spark, "notes", data_dir).collect()]
    assert rows == [(1, 'He said "hi", ok'), (2, "two\nlines"), (None, None)]
    typed = R.read_csv(spark, os.path.join(data_dir, "notes.csv"), "id long, note string")
    assert typed.schema["id"].dataType.simpleString() == "bigint" and typed.where("id is null").count() == 1


def test_csv_types_and_missing_tokens(spark, data_dir):
    df = R.read_dataset(spark, "wine quality", data_dir)
    types = dict(df.dtypes)
    assert types == {"fixed_acidity": "double", "quality": "int", "kind": "string", "flag": "boolean"}
    rows = df.collect()
    assert rows[1]["fixed_acidity"] is None and rows[2]["quality"] is None and rows[2]["kind"] is None


def test_json_records(spark, data_dir):
    df = R.read_records(spark, os.path.join(data_dir, "records.json"))
    assert sorted(df.columns) == ["a", "b"] and df.count() == 2
    col = spark.createDataFrame([(1, '{"k": 3}'), (2, '{"k": 4}')], "id int, props string")
    out = R.read_records(spark, col, column="props", keep=["id"])
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, 3), (2, 4)]


def test_list_datasets_dedup(spark, data_dir):
    names = [r["name"] for r in R.list_datasets(spark, data_dir).collect()]
    assert sorted(names) == sorted(R.BUILT_IN_DATASETS)   # both files are built-in names


@pytest.mark.parametrize("name", ["iris", "boston_housing", "wine_quality", "diabetes", "customer_churn"])
def test_synthetic_presets(spark, name):
    n, spec = PRESETS[name]
    df = synthetic_table(spark, name, seed=1)
    assert df.count() == n and df.columns == list(spec)
    again = synthetic_table(spark, name, seed=1)
    assert df.exceptAll(again).count() == 0


def test_synthetic_bounds_and_shares(spark):
    df = synthetic_table(spark, "diabetes", n=20000, seed=3)
    r = df.agg(F.avg("Outcome").alias("p"), F.min("Pregnancies").alias("lo"), F.max("Pregnancies").alias("hi"),
               F.avg("Glucose").alias("g"), F.min("Insulin").alias("ins")).first()
    se = (0.35 * 0.65 / 20000) ** 0.5
    assert abs(r["p"] - 0.35) < 5 * se
    assert r["lo"] == 0 and r["hi"] == 17 and r["ins"] >= 0
    assert abs(r["g"] - 120) < 5 * 30 / 20000 ** 0.5
    ids = synthetic_table(spark, "customer_churn", seed=3).select("customer_id").first()[0]
    assert ids == "CUST00001"


def test_save_and_load_prepared(spark):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "x int, split string")
    params = {"scaler": spark.createDataFrame([(1.0, 2.0)], "m double, s double")}
    S.save_prepared(df, "unit", params)
    assert S.load_prepared(spark, "unit", split="train").count() == 2
    assert S.load_params(spark, "unit", "scaler").first()["s"] == 2.0


def test_log_run_and_model_id(spark):
    m = spark.createDataFrame([("Accuracy", 0.9)], "name string, value double")
    mid = S.log_run(spark, "random_forest", "unit_ds", m, {"n_estimators": 10})
    assert mid.startswith("random_forest_unit_ds_")
    row = S.load_runs(spark).where(F.col("model_id") == mid).first()
    assert row["metrics"]["Accuracy"] == 0.9
    assert S.model_id("a", "b") != S.model_id("a", "b")


def test_a_broken_write_leaves_the_version_before(spark):
    import uuid
    name = "versions_" + uuid.uuid4().hex
    first = spark.createDataFrame([(1, "train"), (2, "test")], "x int, split string")
    assert S.load_spec(spark, name) is None
    S.save_prepared(first, name, {"scaler": first.select("x")}, spec={"target": "x"})
    reading = S.load_prepared(spark, name)
    broken = spark.range(10).select(F.raise_error(F.lit("broken midway")).cast("int").alias("x"), F.lit("train").alias("split"))
    with pytest.raises(Exception, match="broken midway"):
        S.save_prepared(broken, name, spec={"target": "y"})
    with pytest.raises(Exception, match="broken midway"):  # the table is whole, a parameter table is not
        S.save_prepared(first, name, {"scaler": broken}, spec={"target": "y"})
    assert S.load_spec(spark, name) == {"target": "x"} and S.load_prepared(spark, name).count() == 2
    assert S.load_params(spark, name, "scaler").count() == 2
    S.save_prepared(first.union(first), name, spec={"target": "z"})
    assert S.load_spec(spark, name) == {"target": "z"} and S.load_prepared(spark, name, split="train").count() == 2
    assert reading.count() == 2 and S.load_manifest(spark, name, back=1)["spec"] == {"target": "x"}
    assert S.load_prepared(spark, name, version=S.load_manifest(spark, name, back=1)["version"]).count() == 2
