"""Evaluation: operators E1-E7 (E5 is a plan in ``veritab.plans.report``).

Input is any table with a label column and a prediction (or score) column.
Class metrics come from one count per (label, prediction) pair, so the input,
often the output of a model, is read once and combined before the shuffle. ROC
curves are exact: running counts over the grouped scores are split by ranges
of the score.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import is_numeric_type, qcol

# Metric names as the reference reports them.
ACCURACY, PRECISION, RECALL, F1 = "Accuracy", "Precision", "Recall", "F1 Score"
MSE, RMSE, MAE, R2 = "MSE", "RMSE", "MAE", "R² Score"

#: Ranges per factor of two of the score, and cells per range, in the running
#: counts of a ROC curve.
ROC_RANGES, ROC_CELLS = 256, 1 << 20


def _name_value(pairs) -> Column:
    """inline() of (name, value) rows from a one-row frame."""
    return F.inline(F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
                              for n, v in pairs]))


def _cls(c: str):
    return qcol(c).cast("string")


def _pair(df: DataFrame, label: str, prediction: str):
    """Label and prediction as comparable class strings: numeric pairs (an
    integer label against a double prediction) are compared as doubles."""
    lt, pt = df.schema[label].dataType, df.schema[prediction].dataType
    integral = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(lt, integral) and isinstance(pt, integral):
        return _cls(label), _cls(prediction)
    if is_numeric_type(lt) and is_numeric_type(pt):
        return (qcol(label).cast("double").cast("string"), qcol(prediction).cast("double").cast("string"))
    return _cls(label), _cls(prediction)


def pair_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, count): all that the class metrics need of the input."""
    y, p = _pair(df, label, prediction)
    return (df.select(y.alias("label"), p.alias("prediction"))
            .groupBy("label", "prediction").agg(F.count("*").alias("count")))


# E1 -------------------------------------------------------------------------

def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows where label equals prediction."""
    y, p = _pair(df, label, prediction)
    hit = F.coalesce(y == p, F.lit(False)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))


# E2 -------------------------------------------------------------------------

def _class_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class, NULL included: support, predicted, tp. Every pair counts for
    its label and for its prediction."""
    both = pair_counts(df, label, prediction).select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("count").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("count").alias("predicted"), F.lit(0).cast("bigint").alias("tp")))))
    return both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")])


def _with_rates(counts: DataFrame) -> DataFrame:
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    out = counts.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.withColumn("f1", f1)


def per_class_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class seen in either column: support, predicted, tp, precision,
    recall, f1 (0/0 -> 0)."""
    return _with_rates(_class_counts(df, label, prediction).where(F.col("class").isNotNull()))


def _all_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: accuracy and the macro means, from one pass over ``df``."""
    rates = _with_rates(_class_counts(df, label, prediction))
    return rates.agg(F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
                     *[F.avg(F.when(F.col("class").isNotNull(), F.col(c))).alias(c)
                       for c in ("precision", "recall", "f1")])


def macro_precision_recall_f1(df: DataFrame, label: str = "label",
                              prediction: str = "prediction") -> DataFrame:
    """Unweighted means of the per-class values."""
    return _all_metrics(df, label, prediction).select("precision", "recall", "f1")


def macro_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """Macro ``precision``, ``recall``, ``f1`` within each value of ``by``,
    from rows (by, label, prediction, n)."""
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0.0)
    both = counts.select(*by, F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"), F.lit(0.0).alias("predicted"), hit.alias("tp")),
        F.struct(F.col("prediction").alias("class"), F.lit(0.0).alias("support"), F.col("n").alias("predicted"), F.lit(0.0).alias("tp")))))
    rates = _with_rates(both.groupBy(*by, "class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]))
    return rates.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def classification_metrics(df: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """(name, value) rows: Accuracy, Precision, Recall, F1 Score."""
    return _all_metrics(df, label, prediction).select(
        _name_value([(ACCURACY, F.col("accuracy")), (PRECISION, F.col("precision")),
                     (RECALL, F.col("recall")), (F1, F.col("f1"))]))


# E3 -------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long confusion matrix (label, prediction, count) over the square of all
    classes seen in either column, zeros kept (E3).

    The square is the result's own size; ``pair_counts`` has the cells that
    are not zero, for inputs with so many classes that the square is no use.
    """
    pairs = pair_counts(df, label, prediction)
    classes = (pairs.select(F.explode(F.array("label", "prediction")).alias("c"))
               .where(F.col("c").isNotNull()).distinct())
    square = classes.select(F.col("c").alias("label")).join(
        classes.select(F.col("c").alias("prediction")), F.lit(True))
    return (square.join(pairs, ["label", "prediction"], "left")
            .select("label", "prediction", F.coalesce(F.col("count"), F.lit(0)).alias("count")))


def confusion_matrix_wide(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Square matrix: one row per label, one column per predicted class."""
    long = confusion_matrix(df, label, prediction)
    return long.groupBy("label").pivot("prediction").agg(F.first("count")).orderBy("label")


# E4 -------------------------------------------------------------------------

def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(name, value) rows: MSE, RMSE, MAE, R² Score.

    R² with a constant label is 1 when the residual is 0, else 0.
    """
    y, p = qcol(label).cast("double"), qcol(prediction).cast("double")
    agg = df.agg(F.avg(F.pow(y - p, 2)).alias("mse"), F.avg(F.abs(y - p)).alias("mae"),
                 F.var_pop(y).alias("vy"))
    r2 = (F.when(F.col("vy") == 0, F.when(F.col("mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("mse") / F.col("vy")))
    return agg.select(_name_value([(MSE, F.col("mse")), (RMSE, F.sqrt("mse")),
                                   (MAE, F.col("mae")), (R2, r2)]))


# E6 -------------------------------------------------------------------------

def _score_cells(s: Column) -> tuple[Column, Column]:
    """Two numbers, the second inside the first, that never fall as the score
    rises: ``ROC_RANGES`` ranges per factor of two, so at most about a million
    whatever the scores, and ``ROC_CELLS`` cells in each. A cell holds at most
    2^24 different doubles, however close to each other scores lie."""
    size = F.greatest(F.least(F.log2(F.abs(s)), F.lit(1025.0)), F.lit(-1075.0)) * ROC_RANGES
    coarse = F.floor(size)
    fine = F.floor((size - coarse) * ROC_CELLS)
    by_sign = lambda c: F.when(s == 0, F.lit(0)).when(s > 0, c).otherwise(-c).cast("bigint")
    return by_sign(coarse + 1100 * ROC_RANGES), by_sign(fine)


def _running_counts(grouped: DataFrame, counts: list[str], by: list[str]) -> DataFrame:
    """Running sums ``cum_<count>`` from the highest score ``s`` down, rows of
    one score together, within each value of the columns ``by``.

    They are sums within a cell of scores, plus the totals of the cells above
    in its range, plus those of the ranges above, so no task sorts more than
    the scores of a cell, the cells of a range or the ranges.
    """
    wide, narrow = _score_cells(F.col("s"))
    rows = grouped.withColumn("__wide", wide).withColumn("__narrow", narrow)
    cells = rows.groupBy(*by, "__wide", "__narrow").agg(*[F.sum(c).alias(c) for c in counts])
    ranges = cells.groupBy(*by, "__wide").agg(*[F.sum(c).alias(c) for c in counts])

    def above(part: list[str], order: str):
        w = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(w), F.lit(0)) for c in counts]

    ranges = ranges.select(*by, "__wide", *[x.alias(f"__r{i}") for i, x in enumerate(above(by, "__wide"))])
    cells = cells.select(*by, "__wide", "__narrow", *[x.alias(f"__c{i}") for i, x in enumerate(above([*by, "__wide"], "__narrow"))])
    within = (Window.partitionBy(*by, "__wide", "__narrow").orderBy(F.col("s").desc())
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    joined = rows.join(ranges, [*by, "__wide"]).join(cells, [*by, "__wide", "__narrow"])
    return joined.select(*[qcol(c) for c in grouped.columns],
                         *[(F.col(f"__r{i}") + F.col(f"__c{i}") + F.sum(c).over(within)).alias(f"cum_{c}")
                           for i, c in enumerate(counts)])


def _is_class(df: DataFrame, label: str, value) -> Column:
    if is_numeric_type(df.schema[label].dataType) and not isinstance(value, str):
        return F.coalesce(qcol(label).cast("double") == F.lit(float(value)), F.lit(False))
    return F.coalesce(qcol(label).cast("string") == F.lit(str(value)), F.lit(False))


def _score(c: Column) -> Column:
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def _score_counts(df: DataFrame, label: str, score: str, positive) -> DataFrame:
    """Per distinct score: pos, neg and their running counts ``cum_pos``,
    ``cum_neg`` from the highest score down, and the totals ``n_pos``, ``n_neg``."""
    grouped = (df.select(_score(qcol(score)).alias("s"), _is_class(df, label, positive).alias("y")).where(F.col("s").isNotNull())
               .groupBy("s").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg")))
    totals = grouped.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return _running_counts(grouped, ["pos", "neg"], []).join(F.broadcast(totals), F.lit(True))


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


def roc_points(df: DataFrame, label: str, score: str, positive=1, max_points: int | None = None) -> DataFrame:
    """ROC curve points (threshold, fpr, tpr), one per distinct score, with
    the (inf, 0, 0) start point (E6). Ties share one point; a missing score is
    left out.

    ``max_points`` thins the curve for drawing: of the points in one cell of a
    grid over (fpr, tpr) only the last is kept. The default keeps all.
    """
    pts = _score_counts(df, label, score, positive).select(
        F.col("s").alias("threshold"), _share("cum_neg", "n_neg").alias("fpr"), _share("cum_pos", "n_pos").alias("tpr"))
    if max_points is not None:
        cells = max(1, (max_points - 1) // 2)
        pts = (pts.groupBy(F.floor(F.col("fpr") * cells), F.floor(F.col("tpr") * cells))
               .agg(F.min(F.struct("threshold", "fpr", "tpr")).alias("p")).select("p.threshold", "p.fpr", "p.tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"),
                                            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Exact area under the ROC curve by the trapezoid rule (one row: roc_auc),
    NULL if only one class has scores.

    A score's trapezoid is its negatives times the positives above it and half
    of its own, so the area is a sum of whole numbers over one division."""
    c = _score_counts(df, label, score, positive)
    area = F.sum(F.col("neg").cast("double") * (F.col("cum_pos") - F.col("pos") / 2))
    return c.agg(F.try_divide(area, F.max("n_pos").cast("double") * F.max("n_neg")).alias("roc_auc"))


def class_values(df: DataFrame, probability: str) -> Column:
    """The entries of a vector or array column as an array."""
    return vector_to_array(qcol(probability)) if isinstance(df.schema[probability].dataType, VectorUDT) else qcol(probability)


def class_pair_auc(df: DataFrame, label: str, probability: str = "probability", labels: list | None = None) -> DataFrame:
    """(class, other, auc, n_class, n_other) for every ordered pair of classes
    with rows: how well the probability of ``class`` tells its rows from those
    of ``other`` (E6 for several classes).

    ``probability`` is a vector or an array with an entry per class, in the
    order of ``labels``, which is the model's own (``models.label_order``);
    without it the labels are 0..k-1. Rows without a label or an own class, and
    missing entries, are left out. One pass makes (class, score) counts for
    all classes; the curves are then sums over those.
    """
    values = class_values(df, probability)
    if labels is None:
        own = qcol(label).cast("int")
    else:
        own = F.coalesce(*[F.when(_is_class(df, label, v), F.lit(i)) for i, v in enumerate(labels)])
    stacked = (df.select(own.alias("y"), F.posexplode(values).alias("k", "p")).select("y", "k", _score(F.col("p")).alias("s"))
               .where(F.col("y").isNotNull() & F.col("s").isNotNull()))
    pairs = pair_auc_of_counts(stacked.groupBy("k", "s", "y").agg(F.count(F.lit(1)).alias("n")), [])
    name = F.col("k") if labels is None else F.element_at(F.array(*map(F.lit, labels)), F.col("k") + 1)
    other = F.col("y") if labels is None else F.element_at(F.array(*map(F.lit, labels)), F.col("y") + 1)
    return pairs.select(name.alias("class"), other.alias("other"), "auc", "n_class", "n_other")


def pair_auc_of_counts(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, y, auc, n_class, n_other) within each value of ``by``, from rows
    (by, k, s, y, n): ``n`` rows of class y whose probability of class k is s."""
    grouped = counts.withColumn("pos", F.when(F.col("y") == F.col("k"), F.col("n")).otherwise(F.lit(0)))
    ties = F.sum("pos").over(Window.partitionBy(*by, "k", "s"))
    area = F.col("n").cast("double") * (F.col("cum_pos") - F.col("tied") / 2)
    pairs = (_running_counts(grouped, ["pos"], [*by, "k"]).withColumn("tied", ties)
             .groupBy(*by, "k", "y").agg(F.sum(area).alias("area"), F.sum("n").alias("n")))
    sizes = pairs.where(F.col("k") == F.col("y")).select(*by, "k", F.col("n").alias("n_class"))
    return (pairs.where(F.col("k") != F.col("y")).join(sizes, [*by, "k"])
            .select(*by, "k", "y", (F.col("area") / (F.col("n_class").cast("double") * F.col("n"))).alias("auc"),
                    "n_class", F.col("n").alias("n_other")))


def class_auc(pairs: DataFrame) -> DataFrame:
    """(class, auc): each class against all others together, from ``class_pair_auc``."""
    return pairs.groupBy("class").agg(F.try_divide(F.sum(F.col("auc") * F.col("n_other")), F.sum("n_other")).alias("auc"))


def multiclass_auc(pairs: DataFrame, average: str = "pairs") -> DataFrame:
    """One row ``roc_auc``: the mean over the ordered pairs of classes (Hand
    and Till, 2001) or over the classes against the rest (``average='classes'``);
    NULL with fewer than two classes."""
    if average not in ("pairs", "classes"):
        raise ValueError(f"unknown average {average!r}")
    return (pairs if average == "pairs" else class_auc(pairs)).agg(F.avg("auc").alias("roc_auc"))


def log_loss(df: DataFrame, label: str, probability: str = "probability", labels: list | None = None) -> DataFrame:
    """One row ``log_loss``: the mean of -log of the own class's probability,
    at least 1e-15. ``labels`` as in ``class_pair_auc``; a label the model does
    not know has probability 0, rows without a label are left out."""
    values = class_values(df, probability)
    if labels is None:
        own = qcol(label).cast("int")
    else:
        own = F.coalesce(*[F.when(_is_class(df, label, v), F.lit(i)) for i, v in enumerate(labels)], F.lit(-1))
    p = F.coalesce(F.get(values, own), F.lit(0.0))
    return df.where(qcol(label).isNotNull()).agg(F.avg(-F.log(F.greatest(p, F.lit(1e-15)))).alias("log_loss"))


# E7 -------------------------------------------------------------------------

def feature_importance(model, features: list[str]) -> DataFrame:
    """(feature, importance) rows from a fitted tree ensemble.

    The vector has one entry per feature, so it is model metadata of a fixed
    size, not data.
    """
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, [float(x) for x in imp])),
                                 "feature string, importance double")


#: Rows among which values are exchanged.
EXCHANGE_ROWS = 1000


def permutation_importance(model, df: DataFrame, features: list[str], label: str = "label", task: str = "classification",
                           seed: int = 42) -> DataFrame:
    """(feature, importance, score, score_without) of any model (E7): by how
    much the accuracy falls, or the mean squared error rises, when a feature's
    values are exchanged between rows.

    Rows are dealt into groups of about ``EXCHANGE_ROWS`` by a hash of their
    number, so that repeated rows spread. In a group a feature takes the value
    of the row some places further on, other places for each feature. All
    features' copies, and the rows as they are, go through the model in one
    transform.
    """
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, importance double, score double, score_without double")
    numbered = df.select(*[qcol(c).alias(f"__f{i}") for i, c in enumerate(features)], qcol(label).alias("__label"))
    groups = max(1, numbered.count() // EXCHANGE_ROWS)
    row = F.struct(*numbered.columns)
    dealt = (numbered.select(row.alias("r"), F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).alias("g"))
             .groupBy("g").agg(F.collect_list("r").alias("rows")))
    each = dealt.select("rows", F.posexplode("rows").alias("at", "r"))

    def other(j: int) -> Column:
        size = F.size("rows")
        step = 1 + F.pmod(F.xxhash64(F.lit(seed), F.lit(j)), F.greatest(size - 1, F.lit(1)))
        return F.get("rows", ((F.col("at") + step) % size).cast("int"))

    copies = [F.struct(F.lit(j).alias("__of"), *[(other(j) if i == j else F.col("r"))[f"__f{i}"].alias(f"__f{i}")
                                                 for i in range(len(features))], F.col("r")["__label"].alias("__label"))
              for j in range(-1, len(features))]
    stacked = each.select(F.explode(F.array(*copies)).alias("c")).select("c.*")
    scored = model.transform(stacked.select("__of", *[F.col(f"__f{i}").alias(c) for i, c in enumerate(features)], "__label"))
    y, p = F.col("__label").cast("double"), F.col("prediction").cast("double")
    score = F.coalesce((y == p).cast("double"), F.lit(0.0)) if task == "classification" else -F.pow(y - p, 2)
    scores = scored.groupBy("__of").agg(F.avg(score).alias("s"))
    base = scores.where("__of < 0").select(F.col("s").alias("base"))
    names = F.array(*map(F.lit, features))
    return scores.where("__of >= 0").join(F.broadcast(base), F.lit(True)).select(
        F.element_at(names, F.col("__of") + 1).alias("feature"), (F.col("base") - F.col("s")).alias("importance"),
        F.col("base").alias("score"), F.col("s").alias("score_without"))
