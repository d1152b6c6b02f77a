import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veritab.operators import models as M
from veritab.operators.gates import robustness_test
from veritab.plans.prepare import prepare
from veritab.plans.search import grid_search
from veritab.plans.train import train_dataset
from veritab.sources.synthetic import synthetic_table


@pytest.fixture(scope="module")
def iris(spark):
    df = synthetic_table(spark, "iris", n=600, seed=5)
    # make the class learnable from petal_length
    return df.withColumn("species", F.when(F.col("petal_length") < 2.5, "setosa")
                         .when(F.col("petal_length") < 4.5, "versicolor").otherwise("virginica"))


def test_forest_learns_and_importance(spark, iris):
    res = train_dataset(iris, "random_forest", {"n_estimators": 10, "max_depth": 5}, log=False)
    acc = res.metrics.where(F.col("name") == "Accuracy").first()["value"]
    assert acc > 0.9
    from veritab.operators.evaluate import feature_importance
    imp = {r["feature"]: r["importance"] for r in feature_importance(res.model.stages[-1],
                                                                      res.prepared.features).collect()}
    assert max(imp, key=imp.get) == "petal_length"


def test_forest_regression_and_depth_mapping(spark):
    assert M._depth(None) == 30 and M._depth(0) == 30 and M._depth(12) == 12
    df = synthetic_table(spark, "boston_housing", n=400, seed=2).withColumn("MEDV", F.col("RM") * 3 + F.col("NOX"))
    res = train_dataset(df, "random_forest", {"n_estimators": 10, "max_depth": 6}, log=False)
    r2 = res.metrics.where(F.col("name") == "R² Score").first()["value"]
    assert r2 > 0.5 and res.task == "regression"


def test_svm_linear_and_rbf(spark, iris):
    for kernel in ("linear", "rbf"):
        res = train_dataset(iris, "svm", {"C": 10.0, "kernel": kernel, "max_iter": 30, "n_components": 30},
                            log=False)
        right = res.predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        assert right > 0.8, kernel
        total = res.predictions.select(F.aggregate(vector_to_array("probability"), F.lit(0.0), lambda a, b: a + b)).first()[0]
        assert total == pytest.approx(1.0)
    with pytest.raises(ValueError):
        train_dataset(iris, "svm", {"kernel": "spline"}, log=False)


def test_gradient_model_loss_decreases(spark):
    df = synthetic_table(spark, "wine_quality", n=500, seed=4).withColumn(
        "y", F.col("alcohol") * 2 - F.col("pH"))
    gm = M.GradientModel.fit(df, ["alcohol", "pH", "density"], "y", loss="squared", hidden=(8,),
                             activation="tanh", max_iter=25, lr=0.05)
    assert gm.history[-1] < gm.history[0]
    pred = gm.transform(df)
    assert pred.where(F.col("prediction").isNull()).count() == 0


def test_mlp_classifier_both_paths(spark, iris):
    for act in ("logistic", "relu"):
        res = train_dataset(iris, "neural_network",
                            {"hidden_layer_sizes": [8], "activation": act, "max_iter": 60, "lr": 0.05}
                            if act == "relu" else {"hidden_layer_sizes": [8], "activation": act, "max_iter": 100},
                            log=False)
        assert res.predictions.count() == res.prepared.data.where(F.col("split") == "test").count()
        right = res.predictions.agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]
        assert right > 0.7 and "probability" in res.predictions.columns, act


def test_grid_search_best_is_max(spark, iris):
    p = prepare(iris, ("normalize",))
    s = grid_search(p.data, p.features, p.target, "random_forest", "classification",
                    {"n_estimators": [3, 6], "max_depth": [2, 4]}, k=3)
    rows = s.results.collect()
    assert len(rows) == 4
    assert s.best_score == pytest.approx(max(r["mean_test_score"] for r in rows))
    assert s.scores.count() == 12


def test_robustness_no_noise_no_flip(spark, iris):
    res = train_dataset(iris, "random_forest", {"n_estimators": 5, "max_depth": 4}, log=False)
    test = res.prepared.data.where(F.col("split") == "test")
    r = robustness_test(res.model, test, res.prepared.features, noise=0.0).first()
    assert r["passed"] is True and r["failed_cases"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_svr_reaches_a_linear_target(spark, seed):
    df = synthetic_table(spark, "wine_quality", n=400, seed=seed).select("alcohol", "pH", "density").withColumn(
        "y", F.col("alcohol") * 20 - F.col("pH") * 300 + 1000)
    model = M.train_svm(df, ["alcohol", "pH", "density"], "y", "regression", kernel="linear", seed=seed)
    p = model.transform(df)
    r2 = 1 - p.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)) / F.var_pop("y")).first()[0]
    assert r2 > 0.99
    noise = df.withColumn("y", F.rand(seed))
    p = M.train_svm(noise, ["alcohol", "pH"], "y", "regression", kernel="linear", seed=seed).transform(noise)
    assert 1 - p.agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2)) / F.var_pop("y")).first()[0] > -0.05


def test_missing_features_and_too_deep_trees(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, 4.0)], "x double, y double")
    with pytest.raises(ValueError, match="missing"):
        M.GradientModel.fit(df, ["x"], "y", hidden=(), max_iter=2)
    model = M.GradientModel.fit(df.where("x is not null"), ["x"], "y", hidden=(), max_iter=50)
    assert [r["prediction"] is None for r in model.transform(df).collect()] == [False, True, False]
    with pytest.raises(ValueError):
        M._depth(31)


def test_own_labels_odd_names_and_reload(spark):
    from veritab.sources.storage import load_model, log_run
    df = spark.range(300).select((F.col("id") % 17).cast("double").alias("a.b"), (F.col("id") % 5).cast("double").alias("c`d"),
                                 F.when(F.col("id") % 17 > 8, 2).otherwise(1).alias("y"))
    metrics = spark.createDataFrame([("Accuracy", 1.0)], "name string, value double")
    for kind, params in (("svm", {"kernel": "linear", "C": 10.0}), ("svm", {"kernel": "rbf", "n_components": 20}),
                         ("random_forest", {"n_estimators": 5}),
                         ("neural_network", {"hidden": (4,), "activation": "tanh", "max_iter": 60, "lr": 0.1})):
        model = M.train(df, ["a.b", "c`d"], "y", kind, "classification", params)
        out = model.transform(df)
        assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0] > 0.85, (kind, params)
        again = load_model(spark, log_run(spark, kind, "unit", metrics, params, model=model))
        assert again.transform(df).select("prediction").collect() == out.select("prediction").collect()


def test_load_or_prepare(spark, iris):
    import uuid
    name = "iris_" + uuid.uuid4().hex
    first = train_dataset(iris, "random_forest", {"n_estimators": 5, "max_depth": 4}, log=False, stored_as=name)
    again = train_dataset(iris.limit(0), "random_forest", {"n_estimators": 5, "max_depth": 4}, log=False, stored_as=name)
    assert again.prepared.task_labels == ["setosa", "versicolor", "virginica"]
    assert again.prepared.features == first.prepared.features
    assert again.prepared.scaler is not None and again.prepared.scaler.collect() == first.prepared.scaler.collect()
    assert again.predictions.count() == first.predictions.count() > 0


def test_permutation_importance_of_any_model(spark):
    from veritab.operators.evaluate import permutation_importance
    df = spark.range(3000).select((F.col("id") % 13).cast("double").alias("lead"), (F.col("id") % 7).cast("double").alias("idle"),
                                  (F.col("id") % 13 > 6).cast("int").alias("y"))
    model = M.train_svm(df, ["lead", "idle"], "y", kernel="linear", probability=False, max_iter=30)
    got = {r["feature"]: r for r in permutation_importance(model, df, ["lead", "idle"], "y").collect()}
    assert got["lead"]["importance"] > 0.3 and abs(got["idle"]["importance"]) < 0.02
    assert got["lead"]["score"] == got["idle"]["score"] > 0.95
    again = permutation_importance(model, df, ["lead", "idle"], "y").collect()
    assert sorted(again) == sorted(got.values())
