"""Model training and prediction: operators M1-M8 (M9 is a plan).

Random forests and the sigmoid MLP classifier are Spark ML estimators. Support
vector machines, the other networks and all regressors are trained by
``gradient``: L-BFGS over packed blocks, one pass for all models and steps.
Kernels are feature maps inside those passes: random Fourier features (rbf),
TensorSketch (poly), Nystroem landmarks (sigmoid).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import as_double, qcol
from veritab.operators.gradient import (GradientModel, Landmarks, Moments, Net, RandomFourier, Table, TensorSketch, fit_nets,
                                        fit_platt, pack, wide_columns)

PLAIN_NAME = re.compile(r"[^.`]+")
SPARK_MAX_DEPTH = 30  # Spark's deepest tree; stands for "unlimited"


# M8 -------------------------------------------------------------------------

def assembler(features: list[str], output: str = "features",
              handle_invalid: str = "error") -> list:
    """Pipeline stages for the numeric feature matrix as one vector column (M8).

    ``handle_invalid='error'``: a NULL/NaN feature fails the job, as the
    reference's estimators do. Names that ML stages can't read (with dots or
    backticks) are assembled under generated ones.
    """
    if all(PLAIN_NAME.fullmatch(c) for c in features):
        return [VectorAssembler(inputCols=features, outputCol=output, handleInvalid=handle_invalid)]
    own = [f"__feature_{i}" for i in range(len(features))]
    quoted = ["`" + c.replace("`", "``") + "`" for c in features]
    return [SQLTransformer(statement="SELECT *, " + ", ".join(f"{q} AS {o}" for q, o in zip(quoted, own)) + " FROM __THIS__"),
            VectorAssembler(inputCols=own, outputCol=output, handleInvalid=handle_invalid),
            SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(own)}) FROM __THIS__")]


def assemble(df: DataFrame, features: list[str], output: str = "features") -> DataFrame:
    for stage in assembler(features, output):
        df = stage.transform(df)
    return df


def features_array(df: DataFrame, features: list[str]) -> DataFrame:
    """Assembled features as ARRAY<DOUBLE> (a comparable form of M8's vector)."""
    return assemble(df, features).select(*[qcol(c) for c in df.columns],
                                         vector_to_array("features").alias("features"))


# M1 / M2 ----------------------------------------------------------------------

def _depth(max_depth) -> int:
    if not max_depth:
        return SPARK_MAX_DEPTH
    if int(max_depth) > SPARK_MAX_DEPTH:
        raise ValueError(f"max_depth {max_depth} is beyond the deepest tree possible ({SPARK_MAX_DEPTH})")
    return int(max_depth)


def random_forest(task: str = "classification", n_estimators: int = 100, max_depth=None,
                  min_samples_split: int = 2, seed: int = 42, label: str = "label",
                  max_bins: int = 32):
    """Forest estimator on ``features``/``label`` (M1 classification, M2 regression).

    ``min_samples_split=k`` bounds the parent node in the reference; Spark
    bounds each child, so ``minInstancesPerNode = max(1, k // 2)`` (equal for
    k <= 3, close above). Regression forests consider all features per split.
    """
    common = dict(featuresCol="features", labelCol=label, numTrees=int(n_estimators),
                  maxDepth=_depth(max_depth), minInstancesPerNode=max(1, int(min_samples_split) // 2),
                  seed=seed, maxBins=max_bins)
    if task == "classification":
        return RandomForestClassifier(**common)
    return RandomForestRegressor(featureSubsetStrategy="all", **common)


def train_random_forest(df: DataFrame, features: list[str], label: str = "label",
                        task: str = "classification", **params) -> PipelineModel:
    est = random_forest(task, label=label, **params)
    return Pipeline(stages=[*assembler(features), est]).fit(df)


# M3 -------------------------------------------------------------------------

KERNELS = ("linear", "rbf", "poly", "sigmoid")


def kernel_gamma(moments: Moments, gamma="scale") -> float:
    """'scale' = 1 / (d * var(X)) over all feature values, 'auto' = 1 / d."""
    mean, std = moments.mean[:-1], moments.std[:-1]
    d = len(mean)
    if gamma == "auto":
        return 1.0 / d
    if gamma != "scale":
        return float(gamma)
    var = float(np.mean(std ** 2 + mean ** 2) - np.mean(mean) ** 2)
    return 1.0 / (d * var) if var > 0 else 1.0


def kernel_map(kernel: str, table: Table, moments: Moments, df: DataFrame, gamma="scale", coef0: float = 0.0, degree: int = 3,
               n_components: int = 100, seed: int = 42):
    """The feature map of a kernel, None for the linear one. Wide one-hot
    columns stay linear beside the mapped features."""
    if kernel == "linear":
        return None
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r} is not supported {KERNELS}")
    g = kernel_gamma(moments, gamma)
    if kernel == "rbf":
        return RandomFourier(g, n_components, seed)
    if kernel == "poly":
        return TensorSketch(g, float(coef0), int(degree), n_components, seed)
    # landmarks: the first rows in the order of a hash, a sample of fixed size
    x = F.array(*[as_double(c, df.schema[c].dataType) for c in table.dense])
    rows = df.select(x.alias("x")).orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(n_components).collect()
    return Landmarks(sorted({tuple(r["x"]) for r in rows if None not in r["x"]}), g, float(coef0))


CALIBRATION_FOLDS = 3


def svm_net(df: DataFrame, table: Table, task: str = "classification", C: float = 1.0, kernel: str = "rbf", gamma="scale",
            coef0: float = 0.0, degree: int = 3, n_components: int = 100, seed: int = 42, max_iter: int = 200, epsilon: float = 0.1,
            classes: int = 2, without_fold: int | None = None) -> Net:
    feature_map = kernel_map(kernel, table, table.moments[without_fold], df, gamma, coef0, degree, n_components, seed)
    # the sum of losses is weighed by C against half the squared weights
    return Net("hinge" if task == "classification" else "epsilon_insensitive", classes=classes, penalty=1.0 / C,
               raw_penalty=task == "classification", epsilon=epsilon, seed=seed, max_iter=max_iter, tol=1e-6,
               without_fold=without_fold, feature_map=feature_map)


def train_svm(df: DataFrame, features: list[str], label: str = "label", task: str = "classification", C: float = 1.0,
              kernel: str = "rbf", gamma="scale", n_components: int = 100, seed: int = 42, max_iter: int = 200,
              epsilon: float = 0.1, coef0: float = 0.0, degree: int = 3, probability: bool = True,
              n_classes: int | None = None) -> GradientModel:
    """Support vector machine (M3 classification, M4 regression).

    C weighs the summed loss, as in scikit-learn. Kernels other than the linear
    one are feature maps of ``n_components`` dimensions. Classes are 0..k-1;
    with more than two each is told from the others, in one fit. The probabilities are
    calibrated by Platt's method on margins of three more fits, each without a
    third of the rows, which share the passes of the first one.
    """
    if kernel not in KERNELS:
        raise ValueError(f"kernel {kernel!r} is not supported {KERNELS}")
    calibrate = task == "classification" and probability
    table = pack(df, features, label, folds=CALIBRATION_FOLDS if calibrate else 0)
    try:
        classes = n_classes or (class_count(df, label) if task == "classification" else 1)
        parts = [f for f in range(CALIBRATION_FOLDS) if table.moments[f].n] if calibrate else []
        calibrate = len(parts) == CALIBRATION_FOLDS
        first = svm_net(df, table, task, C, kernel, gamma, coef0, degree, n_components, seed, max_iter, epsilon, max(classes, 2))
        # the parts share the map, so that it is computed once
        nets = [first, *[replace(first, without_fold=f) for f in parts if calibrate]]
        model, *others = fit_nets(table, nets)
        if calibrate:
            model.platt = fit_platt(table, others)
        return model
    finally:
        table.close()


def class_count(df: DataFrame, label: str) -> int:
    most = df.agg(F.max(qcol(label))).first()[0]
    return 1 if most is None else int(most) + 1


# M5 / M6 ----------------------------------------------------------------------

def parse_hidden(hidden) -> tuple[int, ...]:
    """'100,50' / [100, 50] / (100,) -> (100, 50)."""
    if isinstance(hidden, str):
        return tuple(int(x.strip()) for x in hidden.split(",") if x.strip())
    return tuple(int(x) for x in hidden)


def mlp_net(task: str = "classification", hidden="100,50", activation: str = "relu", max_iter: int = 200, alpha: float = 1e-4,
            seed: int = 42, classes: int = 2, without_fold: int | None = None) -> Net:
    return Net("softmax" if task == "classification" else "squared", parse_hidden(hidden), activation,
               classes=max(classes, 2) if task == "classification" else 1, penalty=alpha, seed=seed, max_iter=max_iter, tol=1e-5,
               without_fold=without_fold)


def train_mlp(df: DataFrame, features: list[str], label: str = "label", task: str = "classification", hidden="100,50",
              activation: str = "relu", max_iter: int = 200, alpha: float = 1e-4, seed: int = 42, n_classes: int | None = None,
              lr: float | None = None):
    """Multi-layer perceptron (M5 classification, M6 regression).

    Classification with the sigmoid/logistic activation is Spark ML's
    ``MultilayerPerceptronClassifier``; the rest is trained by ``gradient``.
    ``lr``, the rate of a gradient step, is accepted and has no effect: the
    line search finds the steps.
    """
    k = (n_classes or class_count(df, label)) if task == "classification" else 1
    if task == "classification" and activation in ("sigmoid", "logistic"):
        width = len(features)
        if wide := wide_columns(df, features):
            first = df.select(*wide).first()
            width += sum(first[c].size for c in wide) - len(wide) if first else 0
        mlp = MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[width, *parse_hidden(hidden), k],
                                             maxIter=max_iter, seed=seed)
        return Pipeline(stages=[*assembler(features), mlp]).fit(df)
    table = pack(df, features, label)
    try:
        return fit_nets(table, [mlp_net(task, hidden, activation, max_iter, alpha, seed, k)])[0]
    finally:
        table.close()


# Saving ----------------------------------------------------------------------

def model_to_json(model) -> tuple[str, object | None]:
    """(JSON of what this module's classes hold, the Spark ML model inside or None)."""
    labels, inner = (model.labels, model.model) if isinstance(model, LabelledModel) else (None, model)
    if isinstance(inner, GradientModel):
        return json.dumps({"labels": labels, "gradient": inner.to_dict()}), None
    return json.dumps({"labels": labels, "ml_class": type(inner).__name__}), inner


def model_from_json(text: str, ml_path: str):
    """The inverse of ``model_to_json``; a Spark ML model is read from ``ml_path``."""
    own = json.loads(text)
    model = GradientModel.from_dict(own["gradient"]) if "gradient" in own else PipelineModel.load(ml_path)
    return model if own["labels"] is None else LabelledModel(model, own["labels"])


# M7 -------------------------------------------------------------------------

def predict(model, df: DataFrame) -> DataFrame:
    """Predictions for every row of ``df`` (M7)."""
    return model.transform(df)


@dataclass
class LabelledModel:
    """A classifier trained on indices 0..k-1 that predicts the own labels."""
    model: object
    labels: list

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        return out.withColumn("prediction", F.element_at(F.array(*[F.lit(float(v)) for v in self.labels]),
                                                         F.col("prediction").cast("int") + 1))


#: Classes that a classifier may have. It holds outputs for each, so more are
#: a sign of a label that is none.
MAX_CLASSES = 10_000


def class_counts(df: DataFrame, label: str) -> dict[float, int]:
    """The sorted distinct labels, as doubles, and their rows."""
    own = df.select(qcol(label).cast("double").alias("v")).where(F.col("v").isNotNull())
    rows = own.groupBy("v").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} classes; train a regression or group the labels first")
    return dict(sorted((r["v"], r["n"]) for r in rows))


def class_labels(df: DataFrame, label: str) -> list[float]:
    """The sorted distinct labels, as doubles."""
    return list(class_counts(df, label))


def label_order(model) -> list | None:
    """The labels in the order of the entries of ``probability``; None stands for 0..k-1."""
    return model.labels if isinstance(model, LabelledModel) else None


def train(df: DataFrame, features: list[str], label: str, model_type: str, task: str,
          params: dict | None = None, spread: bool = True):
    """Dispatch by family: random_forest, svm, neural_network. Numeric classes
    other than 0..k-1 are indexed for the fit; predictions are the own labels.
    Without ``spread`` the rows are trained on in the partitions they have."""
    from veritab.session import fit_rows, spread_by_label, spread_for_iterations
    params = dict(params or {})
    counts = class_counts(df, label) if task == "classification" else None
    if spread:
        rows = df.count() if counts is None else sum(counts.values())
        per_task = fit_rows(model_type, len(features), [params])
        by_label = model_type == "random_forest" and task != "classification"
        df = spread_by_label(df, label, rows, per_task) if by_label else spread_for_iterations(df, rows, per_task)
    if counts is not None:
        labels = list(counts)
        if model_type != "random_forest":
            params["n_classes"] = len(labels)
        if labels != [float(i) for i in range(len(labels))]:
            return LabelledModel(_train(index_labels(df, label, labels), features, label, model_type, task, params), labels)
    return _train(df, features, label, model_type, task, params)


def index_labels(df: DataFrame, label: str, labels: list[float]) -> DataFrame:
    index = F.element_at(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, float(i))]), qcol(label).cast("double"))
    return df.select(*[index.alias(c) if c == label else qcol(c) for c in df.columns])


def family_params(model_type: str, params: dict) -> dict:
    """Parameters by this library's names."""
    params = dict(params)
    if "hidden_layer_sizes" in params:
        params["hidden"] = params.pop("hidden_layer_sizes")
    return params


def _train(df: DataFrame, features: list[str], label: str, model_type: str, task: str, params: dict):
    params = family_params(model_type, params)
    if model_type == "random_forest":
        return train_random_forest(df, features, label, task, **params)
    if model_type == "svm":
        return train_svm(df, features, label, task, **params)
    if model_type in ("neural_network", "mlp"):
        return train_mlp(df, features, label, task, **params)
    raise ValueError(f"unknown model type {model_type!r}")
