import tempfile

from pyspark.sql import functions as F

from veritab.operators import prep
from veritab.session import checkpoint_dir, guard_wide_plan, spread_for_iterations
from veritab.sources.readers import read_dataset

from conftest import SF_SMALL


def test_checkpoint_dir_is_read_from_session(spark):
    d = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == d


def test_spread_only_when_thin(spark):
    thin = spark.range(100).coalesce(1)
    assert spread_for_iterations(thin).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    path = tempfile.mkdtemp(prefix="veritab-spread-") + "/wide"
    spark.range(100).repartition(spark.sparkContext.defaultParallelism * 2).write.parquet(path)
    wide = spark.read.parquet(path)
    assert spread_for_iterations(wide) is wide


def test_guard_wide_plan(spark):
    before = spark.conf.get("spark.sql.constraintPropagation.enabled")
    guard_wide_plan(spark, 10)
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == before
    guard_wide_plan(spark, 100)
    assert spark.conf.get("spark.sql.constraintPropagation.enabled") == "false"


def test_read_dataset_parquet_by_name(spark):
    df = read_dataset(spark, "Customer Dataset", SF_SMALL)
    assert "c_mktsegment" in df.columns and df.count() > 0


def test_one_hot_vector_wide_path(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "k int, c string")
    out = prep.one_hot_vector(df, ["c"])
    assert out.columns == ["k", "c_vec"]
    sizes = {r["c_vec"].size for r in out.collect()}
    assert sizes == {3}   # a, b and the kept invalid/NULL slot
