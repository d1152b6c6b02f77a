"""Q11 (test-table profile report) and E5 (evaluation report) as named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import is_numeric_type, qcol
from veritab.operators import drift as D
from veritab.operators import evaluate as E
from veritab.operators import profile as P
from veritab.operators.schema import first_n_numeric, infer_roles, infer_task

# Report sections of the evaluation node.
SECTIONS = ("ClassificationQuality", "RegressionQuality", "ProbClassificationQuality",
            "DataQuality", "DataDrift")


def profile_report(df: DataFrame, target: str | None = None, bins: int = 30,
                   median: str = "exact") -> dict[str, DataFrame]:
    """Target profile, feature statistics, correlations, target histogram and
    summary (Q11). Every entry is a lazy DataFrame."""
    roles = infer_roles(df, target)
    t = roles.target
    task = infer_task(df, t)
    out = {"summary": P.dataset_summary(df, t), "features": P.feature_stats(df, t, median)}
    if task == "regression":
        out["target"] = P.profile_target_regression(df, t, median)
        out["target_histogram"] = P.histogram(df, t, bins)
    else:
        out["target"] = P.profile_target_classes(df, t)
        out["class_counts"] = P.class_counts(df, t)
    if is_numeric_type(df.schema[t].dataType) and roles.numeric:
        out["correlations"] = P.correlation_ranking(df, t)
    return out


def evaluation_report(predictions: DataFrame, split_table: DataFrame, features: list[str],
                      task: str, label: str = "label", prediction: str = "prediction",
                      sections=SECTIONS, shift_columns: int | None = None, labels: list | None = None) -> dict[str, DataFrame]:
    """Metrics, confusion matrix, ROC curve and area of the class
    probabilities, data quality of the test features and the train/test mean
    shift of the numeric features (the first ``shift_columns`` of them if
    given) (E5).

    ``labels`` is the order of the classes in ``probability``
    (``models.label_order``; None: 0..k-1). The curve and the area of two
    classes are those of the second one; of several classes there is the area
    over their pairs, and each class's own against the rest (``class_auc``).
    """
    out = {}
    if task == "classification" and "ClassificationQuality" in sections:
        out["metrics"] = E.classification_metrics(predictions, label, prediction)
        out["confusion_matrix"] = E.confusion_matrix(predictions, label, prediction)
    if (task == "classification" and "ProbClassificationQuality" in sections
            and "probability" in predictions.columns):
        pairs = E.class_pair_auc(predictions, label, "probability", labels)
        first = predictions.select(F.size(E.class_values(predictions, "probability")).alias("k")).where("k > 0").first()
        if first is not None and first["k"] == 2:
            scored = predictions.withColumn("__p1", E.class_values(predictions, "probability")[1])
            out["roc_curve"] = E.roc_points(scored, label, "__p1", positive=1 if labels is None else labels[1])
        out["roc_auc"] = E.multiclass_auc(pairs)
        out["class_auc"] = E.class_auc(pairs)
        out["log_loss"] = E.log_loss(predictions, label, "probability", labels)
    if task != "classification" and "RegressionQuality" in sections:
        out["metrics"] = E.regression_metrics(predictions, label, prediction)
    if "DataQuality" in sections:
        test = split_table.where(F.col("split") == "test").select(*map(qcol, features))
        out["data_quality"] = P.quality_counts(test)
    if "DataDrift" in sections:
        own = split_table.select(*map(qcol, features))
        cols = first_n_numeric(own, len(features) if shift_columns is None else shift_columns)
        shifts = D.mean_shift(split_table, cols)
        out["mean_shift"] = shifts
        out["drift_detected"] = D.mean_shift_detected(shifts)
    return out


def report_long(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, item, name, value): all tables of a report in one. A row's
    text columns, joined by '|', are its ``item``; each number or flag is a
    row of its own, NULL included."""
    parts = []
    for section, df in tables.items():
        plain = [c for c in df.columns if is_numeric_type(df.schema[c].dataType) or df.schema[c].dataType.typeName() == "boolean"]
        text = [qcol(c).cast("string") for c in df.columns if c not in plain]
        cells = F.array(*[F.struct(F.lit(c).alias("name"), qcol(c).cast("double").alias("value")) for c in plain])
        item = F.concat_ws("|", *text) if text else F.lit("")
        parts.append(df.select(F.lit(section).alias("section"), item.alias("item"), F.inline(cells)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
