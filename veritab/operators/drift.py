"""Two-table drift: operators D1-D7.

Shape of every plan here: each side is reduced by partial (map-side)
aggregation to one row, or to one row per (column, category), before anything
is shuffled; the only joins are against frames whose size is bounded by the
number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import (DRIFT_THRESHOLD, EPS_REL, EPS_SHARE, as_category,
                                     as_double, is_numeric_type, qcol)
from veritab.operators.schema import common_columns


def _numeric_pairs(ref: DataFrame, cur: DataFrame, columns=None) -> list[str]:
    cols = columns if columns is not None else common_columns(ref, cur)
    return [c for c in cols if is_numeric_type(ref.schema[c].dataType)
            and is_numeric_type(cur.schema[c].dataType)]


def _categorical_cols(ref: DataFrame, cur: DataFrame, columns=None) -> list[str]:
    cols = columns if columns is not None else common_columns(ref, cur)
    return [c for c in cols if not is_numeric_type(ref.schema[c].dataType)]


def route_columns(ref: DataFrame, cur: DataFrame, columns=None) -> tuple[list[str], list[str]]:
    """(numeric, categorical) drift columns.

    Both numeric -> numeric drift; reference non-numeric -> categorical drift
    (current cast to string); reference numeric but current not -> skipped.
    """
    return _numeric_pairs(ref, cur, columns), _categorical_cols(ref, cur, columns)


# D1 -------------------------------------------------------------------------

@dataclass
class ReducedSide:
    """All that drift needs of a table: one row of moments and the counts of
    its categories (column_name, value, n)."""

    moments: DataFrame
    counts: DataFrame


def reduce_reference(ref: DataFrame, cur: DataFrame, columns=None) -> ReducedSide:
    """``ref`` reduced once, for many comparisons with tables of the columns of
    ``cur``; both parts are written to the checkpoint folder."""
    from veritab.session import checkpoint_dir
    checkpoint_dir(ref.sparkSession)
    num, cat = route_columns(ref, cur, columns)
    moments = _moments(ref, num, "r") if num else ref.sparkSession.range(1)
    stacked = _stacked_values(ref, cat, "r") if cat else ref.sparkSession.createDataFrame([], "column_name string, value string")
    counts = stacked.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    return ReducedSide(moments.checkpoint(), counts.checkpoint())


def _moments(df: DataFrame, cols: list[str], p: str) -> DataFrame:
    aggs = []
    for i, c in enumerate(cols):
        x = as_double(c, df.schema[c].dataType)
        aggs += [F.avg(x).alias(f"{p}m{i}"), F.stddev_samp(x).alias(f"{p}s{i}")]
    return df.agg(*aggs)


def numeric_drift(ref: DataFrame, cur: DataFrame, columns=None, reduced: ReducedSide | None = None) -> DataFrame:
    """Per numeric column: mean of relative |delta mean| and |delta std|.

    Columns: column_name, ref_mean, ref_std, cur_mean, cur_std, drift_score.
    Sample std; a NULL std (one row) or empty side gives a NULL score.
    """
    cols = _numeric_pairs(ref, cur, columns)
    spark = ref.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, ref_mean double, ref_std double, "
                                         "cur_mean double, cur_std double, drift_score double")

    # Two one-row frames: the cross join is between single rows.
    both = (reduced.moments if reduced else _moments(ref, cols, "r")).crossJoin(_moments(cur, cols, "c"))
    structs = []
    for i, c in enumerate(cols):
        rm, rs, cm, cs = (F.col(f"rm{i}"), F.col(f"rs{i}"), F.col(f"cm{i}"), F.col(f"cs{i}"))
        score = ((F.abs(rm - cm) / (F.abs(rm) + EPS_REL))
                 + (F.abs(rs - cs) / (F.abs(rs) + EPS_REL))) / 2
        structs.append(F.struct(F.lit(c).alias("column_name"), rm.alias("ref_mean"),
                                rs.alias("ref_std"), cm.alias("cur_mean"),
                                cs.alias("cur_std"), score.alias("drift_score")))
    return both.select(F.inline(F.array(*structs)))


# D2 -------------------------------------------------------------------------

def _stacked_values(df: DataFrame, cols: list[str], side: str) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             as_category(c, df.schema[c].dataType).alias("value"))
                    for c in cols])
    return (df.select(F.inline(arr))
            .where(F.col("value").isNotNull())
            .withColumn("side", F.lit(side)))


def category_counts(ref: DataFrame, cur: DataFrame, cols: list[str], reduced: ReducedSide | None = None) -> DataFrame:
    """(column_name, value, n_ref, n_cur) over the union of categories.

    One shuffle; the aggregation is partial before it, so a hot category
    reaches the exchange as one row per input partition.
    """
    if reduced:
        own = _stacked_values(cur, cols, "c").groupBy("column_name", "value").agg(F.count("*").alias("n_cur"))
        both = own.withColumn("n_ref", F.lit(0)).unionByName(reduced.counts.withColumnRenamed("n", "n_ref").withColumn("n_cur", F.lit(0)))
        return both.groupBy("column_name", "value").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    both = _stacked_values(ref, cols, "r").unionByName(_stacked_values(cur, cols, "c"))
    return (both.groupBy("column_name", "value")
            .agg(F.count_if(F.col("side") == "r").alias("n_ref"),
                 F.count_if(F.col("side") == "c").alias("n_cur")))


def category_shares(counts: DataFrame) -> DataFrame:
    """Add ``p_ref``/``p_cur`` shares of the non-missing count per column.

    Totals are one row per column (bounded by the column count) and are
    broadcast back, instead of a window over all categories of a column.
    """
    totals = counts.groupBy("column_name").agg(F.sum("n_ref").alias("t_ref"),
                                                F.sum("n_cur").alias("t_cur"))
    return (counts.join(F.broadcast(totals), "column_name")
            .withColumn("p_ref", F.try_divide(F.col("n_ref"), F.col("t_ref")))
            .withColumn("p_cur", F.try_divide(F.col("n_cur"), F.col("t_cur"))))


def categorical_drift(ref: DataFrame, cur: DataFrame, columns=None, reduced: ReducedSide | None = None) -> DataFrame:
    """Jensen-Shannon divergence (natural log) per categorical column.

    A zero share becomes 1e-10, the others keep their value; capped at 1.
    Both sides empty -> 0. Columns: column_name, drift_score.
    """
    cols = _categorical_cols(ref, cur, columns)
    spark = ref.sparkSession
    if not cols:
        return spark.createDataFrame([], "column_name string, drift_score double")
    shares = category_shares(category_counts(ref, cur, cols, reduced))
    p = F.when(F.col("p_ref") == 0, F.lit(EPS_SHARE)).otherwise(F.col("p_ref"))
    q = F.when(F.col("p_cur") == 0, F.lit(EPS_SHARE)).otherwise(F.col("p_cur"))
    m = (p + q) / 2
    term = 0.5 * (p * F.ln(p / m) + q * F.ln(q / m))
    per_col = shares.groupBy("column_name").agg(F.sum(term).alias("js"))
    # Every requested column gets a row, even when both sides are empty.
    names = spark.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in cols])).alias("column_name"))
    return (names.join(F.broadcast(per_col), "column_name", "left")
            .select("column_name",
                    F.least(F.lit(1.0), F.coalesce(F.col("js"), F.lit(0.0))).alias("drift_score")))


# D6 / D3 --------------------------------------------------------------------

def drift_report(ref: DataFrame, cur: DataFrame, columns=None,
                 threshold: float = DRIFT_THRESHOLD, reduced: ReducedSide | None = None) -> DataFrame:
    """Per column: column_name, column_type, drift_score, drift_detected.
    With ``reduced`` (``reduce_reference``), ``ref`` gives its columns only."""
    num = numeric_drift(ref, cur, columns, reduced).select(
        "column_name", F.lit("numeric").alias("column_type"), "drift_score")
    cat = categorical_drift(ref, cur, columns, reduced).select(
        "column_name", F.lit("categorical").alias("column_type"), "drift_score")
    return (num.unionByName(cat)
            .withColumn("drift_detected",
                        F.coalesce(F.col("drift_score") > threshold, F.lit(False))))


def dataset_drift(ref: DataFrame, cur: DataFrame, columns=None,
                  threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Mean of column scores and ``drift_score > threshold`` (D3).

    One row: drift_score, drift_detected, n_columns. No common column ->
    score 0, not detected. A NULL column score makes the mean NULL (as NaN
    does in pandas) and the flag false.
    """
    rep = drift_report(ref, cur, columns, threshold)
    n = F.count("*")
    score = (F.when(n == 0, F.lit(0.0))
             .when(F.count("drift_score") < n, F.lit(None).cast("double"))
             .otherwise(F.avg("drift_score")))
    return (rep.agg(score.alias("drift_score"), n.alias("n_columns"))
            .select("drift_score",
                    F.coalesce(F.col("drift_score") > threshold, F.lit(False)).alias("drift_detected"),
                    "n_columns"))


# D4 -------------------------------------------------------------------------

def mean_shift(df: DataFrame, columns: list[str], split_col: str = "split",
               train: str = "train", test: str = "test", pct: float = 20.0) -> DataFrame:
    """Train/test mean shift in percent per column.

    One pass with conditional averages over the split table. Columns:
    column_name, train_mean, test_mean, shift_pct, shifted.
    """
    aggs = []
    for i, c in enumerate(columns):
        x = as_double(c, df.schema[c].dataType)
        aggs += [F.avg(F.when(F.col(split_col) == train, x)).alias(f"a{i}"),
                 F.avg(F.when(F.col(split_col) == test, x)).alias(f"b{i}")]
    structs = []
    for i, c in enumerate(columns):
        a, b = F.col(f"a{i}"), F.col(f"b{i}")
        shift = F.abs(a - b) / (F.abs(a) + EPS_REL) * 100
        structs.append(F.struct(F.lit(c).alias("column_name"), a.alias("train_mean"),
                                b.alias("test_mean"), shift.alias("shift_pct"),
                                F.coalesce(shift > pct, F.lit(False)).alias("shifted")))
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def mean_shift_detected(shifts: DataFrame) -> DataFrame:
    """One row: any column shifted (D4 summary)."""
    return shifts.agg(F.coalesce(F.bool_or("shifted"), F.lit(False)).alias("drift_detected"),
                      F.max("shift_pct").alias("max_shift_pct"))


# D5 -------------------------------------------------------------------------

def target_drift(ref: DataFrame, cur: DataFrame, target: str,
                 threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """Drift of the target column by its role (D5): one drift_report row.

    The distribution data behind it are ``profile.histogram`` (numeric) and
    ``profile.category_frequencies`` (categorical) on both sides.
    """
    return drift_report(ref, cur, [target], threshold)


def target_drift_data(ref: DataFrame, cur: DataFrame, target: str, bins: int = 30,
                      threshold: float = DRIFT_THRESHOLD) -> dict[str, DataFrame]:
    """D5 in full: the drift row plus the distribution data of both sides —
    equal-width histograms (numeric target, bins over each side's own range,
    as the reference plots them) or category frequencies (categorical)."""
    from veritab.operators.profile import category_frequencies, histogram
    out = {"drift": target_drift(ref, cur, target, threshold)}
    if is_numeric_type(ref.schema[target].dataType) and is_numeric_type(cur.schema[target].dataType):
        out["reference_histogram"] = histogram(ref, target, bins)
        out["current_histogram"] = histogram(cur, target, bins)
    else:
        out["frequencies"] = category_frequencies(ref, cur, target)
    return out


# D7 -------------------------------------------------------------------------

def compare_quality(ref: DataFrame, cur: DataFrame) -> DataFrame:
    """Quality counts of both tables side by side (D7): one row per side."""
    from veritab.operators.profile import quality_counts
    return (quality_counts(ref).select(F.lit("reference").alias("side"), "*")
            .unionByName(quality_counts(cur).select(F.lit("current").alias("side"), "*")))


def compare_profiles(ref: DataFrame, cur: DataFrame, target: str | None = None) -> dict:
    """Q1/Q2 + Q9 of both tables as named long tables (D7, full form)."""
    from veritab.operators import profile as P
    out = {"quality": compare_quality(ref, cur)}
    for side, df in (("reference", ref), ("current", cur)):
        out[f"numeric_{side}"] = P.profile_numeric(df, target)
        out[f"categorical_{side}"] = P.profile_categorical(df, target=target)
    return out
