"""Gates and test suites: operators G1-G8.

Every test is a table of cases (case, value, limit, passed) computed on the
executors, folded into one result row (name, passed, total_cases,
failed_cases, details). Metric and requirement tables are a handful of rows,
so joins against them are broadcast joins of a bounded side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import as_category, as_double, is_numeric_type, qcol
from veritab.operators.profile import distinct_rows

# Metrics where lower is better.
LOWER_IS_BETTER = ["Latency", "Latency (ms)", "MSE", "RMSE", "MAE", "log_loss", "rmse",
                   "mse", "mae"]
# Evaluation targets of the reference's evaluation node.
DEFAULT_TARGETS = {"Accuracy": 0.9, "Precision": 0.85, "Recall": 0.8, "F1 Score": 0.85,
                   "Latency (ms)": 100.0}
DEFAULT_TARGET_OTHER = 0.8
# Performance test thresholds of the reference's test node.
DEFAULT_THRESHOLDS = {"accuracy": 0.8, "precision": 0.75, "recall": 0.7, "f1Score": 0.75}
# Metric name for each threshold key.
THRESHOLD_METRIC = {"accuracy": "Accuracy", "precision": "Precision", "recall": "Recall",
                    "f1Score": "F1 Score"}
# Test names of the reference's test suite.
TEST_DATA_QUALITY = "DataQualityTest"
TEST_PERFORMANCE = "ModelPerformanceTest"
TEST_DRIFT = "DataDriftTest"
TEST_BIAS = "BiasTest"
TEST_ADVERSARIAL = "AdversarialTest"

QUALITY_CHUNK = 32  # columns per aggregate in the data-quality cases


def _direction(name: Column) -> Column:
    return F.when(name.isin(LOWER_IS_BETTER), F.lit("<=")).otherwise(F.lit(">="))


def _meets(value: Column, threshold: Column, direction: Column) -> Column:
    return F.when(direction == "<=", value <= threshold).otherwise(value >= threshold)


# G1 -------------------------------------------------------------------------

def check_requirements(metrics: DataFrame, requirements: DataFrame) -> DataFrame:
    """Status per requirement: 'met', 'not-met' or 'unknown' (no such metric) (G1).

    ``requirements`` has name, threshold and optionally direction and
    description; a missing direction is '<=' for latency/error metrics.
    """
    req = requirements
    if "direction" not in req.columns:
        req = req.withColumn("direction", _direction(F.col("name")))
    if "description" not in req.columns:
        req = req.withColumn("description", F.lit(None).cast("string"))
    m = metrics.select("name", F.col("value").cast("double").alias("value"))
    j = req.join(F.broadcast(m), "name", "left")
    status = (F.when(F.col("value").isNull(), F.lit("unknown"))
              .when(_meets(F.col("value"), F.col("threshold").cast("double"), F.col("direction")),
                    F.lit("met")).otherwise(F.lit("not-met")))
    return j.select("name", F.col("threshold").cast("double").alias("threshold"), "direction",
                    "description", "value", status.alias("status"))


# G2 -------------------------------------------------------------------------

def evaluation_gate(metrics: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Per metric: target (given, else the default for its name), passed."""
    m = metrics.select("name", F.col("value").cast("double").alias("value"))
    default = F.lit(DEFAULT_TARGET_OTHER)
    for k, v in DEFAULT_TARGETS.items():
        default = F.when(F.col("name") == k, F.lit(v)).otherwise(default)
    if targets is not None:
        m = m.join(F.broadcast(targets.select("name", F.col("target").cast("double").alias("given"))),
                   "name", "left")
        tgt = F.coalesce(F.col("given"), default)
    else:
        tgt = default
    out = m.withColumn("target", tgt).withColumn("direction", _direction(F.col("name")))
    passed = F.coalesce(_meets(F.col("value"), F.col("target"), F.col("direction")), F.lit(False))
    return out.select("name", "value", "target", "direction", passed.alias("passed"))


def gate_status(gate: DataFrame) -> DataFrame:
    """One row: requirements_met (all metrics pass) and the status text."""
    met = F.coalesce(F.bool_and("passed"), F.lit(False))
    return gate.agg(met.alias("requirements_met")).select(
        "requirements_met",
        F.when(F.col("requirements_met"), "Requirements Met").otherwise("Requirements Not Met")
        .alias("status"))


# G3 -------------------------------------------------------------------------

def details_text(total: Column, failed: Column) -> Column:
    """Details sentence of a test result. The two sentences."""
    return F.when(failed > 0, F.format_string("Ran %d test cases with %d failures.", total, failed)) \
        .otherwise(F.format_string("All %d test cases passed successfully.", total))


def summarize_cases(cases: DataFrame, name: str) -> DataFrame:
    """Fold a case table (with a boolean ``passed``) into one test result row.
    A test without cases has shown nothing and does not pass."""
    agg = cases.agg(F.count("*").alias("total_cases"),
                    F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("failed_cases"))
    return agg.select(F.lit(name).alias("name"), ((F.col("failed_cases") == 0) & (F.col("total_cases") > 0)).alias("passed"),
                      "total_cases", "failed_cases",
                      details_text(F.col("total_cases"), F.col("failed_cases")).alias("details"))


def suite_summary(results: DataFrame) -> DataFrame:
    """total, passed, failed and overall status of a list of test results."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"),
                       F.count_if(~F.col("passed")).alias("failed")).select(
        "total", "passed", "failed",
        F.when(F.col("failed") == 0, "passed").otherwise("failed").alias("status"))


# G4 -------------------------------------------------------------------------

def data_quality_cases(df: DataFrame, max_missing_pct: float = 5.0,
                       max_duplicate_pct: float = 5.0) -> DataFrame:
    """One case per column (missing share within the limit) plus one for
    duplicate rows; all from one aggregate and one distinct."""
    n = F.count("*")
    fields = df.schema.fields
    per_col = None
    # A bounded number of aggregate functions per aggregate node keeps each
    # generated method small enough for the JIT on wide tables.
    for start in range(0, max(len(fields), 1), QUALITY_CHUNK):
        chunk = fields[start:start + QUALITY_CHUNK]
        if not chunk:
            break
        structs = [F.struct(F.lit(f"missing:{f.name}").alias("case"),
                            (F.try_divide(F.count_if(as_category(f.name, f.dataType).isNull()), n) * 100)
                            .alias("value"))
                   for f in chunk]
        part = df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
        per_col = part if per_col is None else per_col.unionByName(part)
    if per_col is None:
        per_col = df.sparkSession.createDataFrame([], "case string, value double")
    per_col = per_col.withColumn("limit", F.lit(float(max_missing_pct)))
    dup = (df.agg(n.alias("n")).crossJoin(distinct_rows(df).withColumnRenamed("n_distinct", "d"))
           .select(F.lit("duplicate_rows").alias("case"),
                   (F.try_divide(F.col("n") - F.col("d"), F.col("n")) * 100).alias("value"),
                   F.lit(float(max_duplicate_pct)).alias("limit")))
    cases = per_col.unionByName(dup)
    # Without rows there is no value, and no evidence is no pass.
    return cases.withColumn("passed", F.coalesce(F.col("value") <= F.col("limit"), F.lit(False)))


def data_quality_test(df: DataFrame, max_missing_pct: float = 5.0,
                      max_duplicate_pct: float = 5.0) -> DataFrame:
    """G4 result row."""
    return summarize_cases(data_quality_cases(df, max_missing_pct, max_duplicate_pct),
                           TEST_DATA_QUALITY)


# G5 -------------------------------------------------------------------------

def performance_cases(metrics: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """One case per threshold: the metric reaches it, or, where lower is
    better (errors, latency), stays within it."""
    th = dict(DEFAULT_THRESHOLDS)
    th.update(thresholds or {})
    spark = metrics.sparkSession
    tdf = spark.createDataFrame([(THRESHOLD_METRIC.get(k, k), float(v)) for k, v in th.items()],
                                "name string, limit double")
    j = tdf.join(F.broadcast(metrics.select("name", F.col("value").cast("double"))), "name", "left")
    return j.select(F.col("name").alias("case"), "value", "limit",
                    F.coalesce(_meets(F.col("value"), F.col("limit"), _direction(F.col("name"))), F.lit(False))
                    .alias("passed"))


def performance_test(metrics: DataFrame, thresholds: dict | None = None) -> DataFrame:
    """G5 result row."""
    return summarize_cases(performance_cases(metrics, thresholds), TEST_PERFORMANCE)


# G6 -------------------------------------------------------------------------

def drift_test(ref: DataFrame, cur: DataFrame, columns=None, threshold: float = 0.1) -> DataFrame:
    """G6 result row: one case per column, passed when no drift is detected."""
    from veritab.operators.drift import drift_report
    rep = drift_report(ref, cur, columns, threshold)
    return summarize_cases(rep.select(F.col("column_name").alias("case"),
                                      F.col("drift_score").alias("value"),
                                      F.lit(threshold).alias("limit"),
                                      (~F.col("drift_detected")).alias("passed")), TEST_DRIFT)


# G7 -------------------------------------------------------------------------

def fairness_by_group(df: DataFrame, group: str, label: str = "label",
                      prediction: str = "prediction", positive=1) -> DataFrame:
    """Per group: n, selection_rate, true_positive_rate, accuracy (one group-by)."""
    y = qcol(label).cast("string") == F.lit(str(positive))
    p = qcol(prediction).cast("string") == F.lit(str(positive))
    if is_numeric_type(df.schema[label].dataType) and is_numeric_type(df.schema[prediction].dataType):
        y = qcol(label).cast("double") == F.lit(float(positive))
        p = qcol(prediction).cast("double") == F.lit(float(positive))
    eq = (qcol(label).cast("double") == qcol(prediction).cast("double")
          if is_numeric_type(df.schema[label].dataType) and is_numeric_type(df.schema[prediction].dataType)
          else qcol(label).cast("string") == qcol(prediction).cast("string"))
    return (df.groupBy(as_category(group, df.schema[group].dataType).alias("group"))
            .agg(F.count("*").alias("n"),
                 F.avg(p.cast("double")).alias("selection_rate"),
                 F.try_divide(F.count_if(y & p), F.count_if(y)).alias("true_positive_rate"),
                 F.avg(F.coalesce(eq, F.lit(False)).cast("double")).alias("accuracy")))


def fairness_cases(df: DataFrame, group: str, label: str = "label", prediction: str = "prediction",
                   positive=1, max_gap: float = 0.1) -> DataFrame:
    """One case per rate: gap = max - min over groups, passed when <= max_gap.

    ``groups`` have the rate, ``left_out`` have none (no row with a positive
    label). A rate of fewer than two groups compares nothing: its gap is NULL
    and the case is not passed."""
    g = fairness_by_group(df, group, label, prediction, positive)
    structs = [F.struct(F.lit(m).alias("case"), F.when(F.count(m) >= 2, F.max(m) - F.min(m)).alias("value"),
                        F.count(m).alias("groups"), F.count_if(F.col(m).isNull()).alias("left_out"))
               for m in ("selection_rate", "true_positive_rate", "accuracy")]
    return (g.agg(F.array(*structs).alias("a")).select(F.inline("a"))
            .withColumn("limit", F.lit(float(max_gap)))
            .withColumn("passed", F.coalesce(F.col("value") <= F.col("limit"), F.lit(False))))


def fairness_test(df: DataFrame, group: str, label: str = "label", prediction: str = "prediction",
                  positive=1, max_gap: float = 0.1) -> DataFrame:
    """G7 result row."""
    return summarize_cases(fairness_cases(df, group, label, prediction, positive, max_gap), TEST_BIAS)


# G8 -------------------------------------------------------------------------

def robustness_flip_rate(model, df: DataFrame, features: list[str], noise: float = 0.1,
                         seed: int = 42) -> DataFrame:
    """Share of rows whose prediction changes when every numeric feature gets
    seeded Gaussian noise of ``noise`` x its std (one row: flip_rate, n).

    The stds are one row, fetched once. The model (of any family) is applied to
    a row, its prediction is kept beside the row, and it is applied again to
    the row with noise: no join and no shuffle.
    """
    numeric = [c for c in features if is_numeric_type(df.schema[c].dataType)]
    stds = df.agg(F.lit(0.0), *[F.stddev_samp(as_double(c, df.schema[c].dataType)) for c in numeric]).first()
    clean = model.transform(df).select(*[qcol(c) for c in df.columns], F.col("prediction").alias("__clean"))
    noisy = []
    for i, f in enumerate(df.schema.fields):
        c = qcol(f.name)
        if f.name in numeric:
            sd = stds[1 + numeric.index(f.name)] or 0.0
            c = (as_double(f.name, f.dataType) + F.randn(seed + i) * (noise * sd)).alias(f.name)
        noisy.append(c)
    out = model.transform(clean.select(*noisy, "__clean"))
    flip = (F.col("prediction") != F.col("__clean")).cast("double")
    return out.agg(F.avg(flip).alias("flip_rate"), F.count("*").alias("n"))


def robustness_test(model, df: DataFrame, features: list[str], noise: float = 0.1,
                    max_flip: float = 0.1, seed: int = 42) -> DataFrame:
    """G8 result row: one case, passed when the flip rate is within ``max_flip``."""
    fr = robustness_flip_rate(model, df, features, noise, seed)
    cases = fr.select(F.lit("prediction_flip_rate").alias("case"), F.col("flip_rate").alias("value"),
                      F.lit(float(max_flip)).alias("limit"),
                      (F.col("flip_rate") <= max_flip).alias("passed"))
    return summarize_cases(cases, TEST_ADVERSARIAL)
