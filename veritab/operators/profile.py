"""Profiling aggregations: operators Q1-Q10.

Numeric profiles are one-row aggregates (partial aggregation on every
executor, a single small row per chunk of columns), reshaped to long form
with ``inline``; exact medians come from ``exact_medians``. Categorical
profiles stack all categorical columns into (column_name, value) rows and
group once, so the cost is one shuffle of pre-aggregated counts however many
columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import (as_category, as_double, corrected_skew,
                                     is_numeric_type, pairwise_corr, qcol)
from veritab.operators.schema import infer_roles, normalize_missing

APPROX_ACCURACY = 10_000  # of median="approx"
MOMENT_CHUNK = 2  # numeric-profile columns per aggregate node (see profile_numeric)


def _median(x: Column, mode: str) -> Column:
    """Single-aggregate median: Spark's exact ``percentile`` or the sketch."""
    if mode == "exact_agg":
        return F.percentile(x, F.lit(0.5))
    return F.percentile_approx(x, F.lit(0.5), F.lit(APPROX_ACCURACY)).cast("double")


MEDIAN_BUCKETS = 1024
MEDIAN_COLLECT_MAX = 100_000
MEDIAN_RANGES = 64  # ranges per factor of two in the first round
# Up to this many values per column Spark's exact ``percentile`` aggregate is
# used (its buffer holds the distinct values of a column, which is bounded
# by this count); above it, the bucket refinement below.
MEDIAN_AGG_MAX_ROWS = 1_000_000
#: Columns whose values one aggregate holds at the same time.
MEDIAN_COLUMNS = 8


def exact_medians(df: DataFrame, columns: list[str], buckets: int = MEDIAN_BUCKETS,
                  collect_max: int = MEDIAN_COLLECT_MAX,
                  agg_max_rows: int = MEDIAN_AGG_MAX_ROWS) -> dict[str, float | None]:
    """Exact (interpolated, as pandas) median of every column.

    One aggregate gives n, min and max per column. Small columns (at most
    ``agg_max_rows`` values) then use Spark's exact ``percentile``. Larger
    ones never build a per-column buffer, sort a column or window over it;
    each refinement round is one job whose shuffle is bounded by
    ``intervals x buckets`` rows:

    * values are stacked as (column, value) and joined to a broadcast table
      of open intervals (two per column at most);
    * in the first round a value's bucket is its sign and its logarithm in
      steps of 1/64 octave (infinities have their own), whatever the range;
      later it is an equal-width bucket inside the interval. A partial hash
      aggregation returns count, min and max per bucket;
    * the bucket holding the middle rank becomes the next interval, bounded
      by that bucket's own min and max (bucketing is monotone, so the bucket
      is exactly the values in [min, max]); outliers therefore cannot keep
      the mass in one bucket;
    * a bucket with one distinct value is the answer; one with at most
      ``collect_max`` values is counted per distinct value and ranked.
    """
    spark = df.sparkSession
    out: dict[str, float | None] = {c: None for c in columns}
    if not columns:
        return out
    xs = [as_double(c, df.schema[c].dataType) for c in columns]
    st = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(xs)],
                *[F.min(x).alias(f"lo{i}") for i, x in enumerate(xs)],
                *[F.max(x).alias(f"hi{i}") for i, x in enumerate(xs)]).first()
    small = [i for i in range(len(columns)) if st[f"n{i}"] and st[f"n{i}"] <= agg_max_rows]
    for start in range(0, len(small), MEDIAN_COLUMNS):
        some = small[start:start + MEDIAN_COLUMNS]
        row = df.agg(*[F.percentile(xs[i], F.lit(0.5)).alias(f"m{i}") for i in some]).first()
        for i in some:
            out[columns[i]] = row[f"m{i}"]
    searches = []   # one per (large column, middle rank)
    for i in range(len(columns)):
        n = st[f"n{i}"]
        if not n or i in small:
            continue
        for r in sorted({(n - 1) // 2, n // 2}):
            lo, hi = st[f"lo{i}"], st[f"hi{i}"]
            searches.append({"i": i, "r": r, "lo": lo, "hi": hi, "value": lo if lo == hi else None})
    if searches:
        stacked = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("k"), x.alias("x"))
                                                for i, x in enumerate(xs)]))).where(F.col("x").isNotNull())
        x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")

        def open_intervals(items):
            groups: dict[tuple, list] = {}
            for s in items:
                groups.setdefault((s["i"], s["lo"], s["hi"]), []).append(s)
            params = spark.createDataFrame([(g, i, float(a), float(b)) for g, (i, a, b) in enumerate(groups)],
                                           "g int, k int, lo double, hi double")
            sel = stacked.join(F.broadcast(params), "k").where(x.between(lo, hi))
            return list(groups.values()), sel

        size = F.floor(F.greatest(F.least(F.log2(F.abs(x)), F.lit(1025.0)), F.lit(-1075.0)) * MEDIAN_RANGES)
        size = size + 1100 * MEDIAN_RANGES
        first = F.when(x == 0, F.lit(0)).when(x > 0, size).otherwise(-size).cast("int")
        wide = True
        while active := [s for s in searches if s["value"] is None]:
            groups, sel = open_intervals(active)
            b = first if wide else F.least(F.floor((x - lo) / (hi - lo) * buckets), F.lit(buckets - 1)).cast("int")
            wide = False
            hist: dict[int, list] = {}
            for r in (sel.groupBy("g", b.alias("b"))
                      .agg(F.count("*").alias("cnt"), F.min("x").alias("mn"), F.max("x").alias("mx"))
                      .collect()):
                hist.setdefault(r["g"], []).append(r)
            finals = []
            for g, members in enumerate(groups):
                rows = sorted(hist.get(g, []), key=lambda r: r["b"])
                for s in members:
                    below = 0
                    for row in rows:
                        if below + row["cnt"] > s["r"]:
                            break
                        below += row["cnt"]
                    s["r"] -= below
                    s["lo"], s["hi"] = row["mn"], row["mx"]
                    if row["mn"] == row["mx"]:
                        s["value"] = row["mn"]
                    elif row["cnt"] <= collect_max:
                        finals.append(s)
            if finals:
                fgroups, fsel = open_intervals(finals)
                counts: dict[int, list] = {}
                for r in fsel.groupBy("g", "x").agg(F.count("*").alias("cnt")).collect():
                    counts.setdefault(r["g"], []).append((r["x"], r["cnt"]))
                for g, members in enumerate(fgroups):
                    ordered = sorted(counts.get(g, []))
                    for s in members:
                        seen = 0
                        for v, cnt in ordered:
                            if seen + cnt > s["r"]:
                                s["value"] = v
                                break
                            seen += cnt
        picked: dict[int, list] = {}
        for s in searches:
            picked.setdefault(s["i"], []).append(s["value"])
        for i, vals in picked.items():
            a, z = vals[0], vals[-1]
            out[columns[i]] = a if a == z else a + (z - a) * 0.5
    return out


def resolve_median_mode(median: str) -> str:
    """'exact' ('auto' is the same) or, only where asked for, 'approx'."""
    if median not in ("exact", "approx", "exact_agg", "auto"):
        raise ValueError(f"median must be exact, approx or auto, got {median!r}")
    return "exact" if median == "auto" else median


def _chunks(seq: list, n: int) -> list[list]:
    return [seq[i:i + n] for i in range(0, len(seq), n)] or [[]]


# Q1 -------------------------------------------------------------------------

NUMERIC_PROFILE_COLS = ["min", "max", "mean", "median", "std", "skew", "missing",
                        "corr_target"]


def profile_numeric(df: DataFrame, target: str | None = None, columns: list[str] | None = None,
                    median: str = "exact", with_corr: bool = True) -> DataFrame:
    """Per numeric column: min, max, mean, median, std, skew, missing, corr_target (Q1).

    ``std`` is the sample std, ``skew`` the bias-corrected one, ``corr_target``
    the pairwise Pearson correlation with a numeric target (0 when the target
    is not numeric, NULL when undefined).
    """
    if columns is None:
        roles = infer_roles(df, target)
        columns = roles.numeric
    mode = resolve_median_mode(median)
    tgt = None
    tgt_numeric = False
    if with_corr and target is not None:
        tgt_numeric = is_numeric_type(df.schema[target].dataType)
        tgt = as_double(target, df.schema[target].dataType) if tgt_numeric else None
    # Exact medians for all columns first (a few bounded jobs, see
    # ``exact_medians``); they enter the per-chunk rows as literals.
    meds = exact_medians(df, columns) if mode == "exact" else {}
    parts = []
    # A handful of columns per aggregate: ~10 aggregate functions per column,
    # and one generated method per aggregate node; past ~20 functions the
    # method outgrows the JIT's size limit and runs interpreted (several
    # times slower). Each chunk reads only its own columns from the scan.
    for chunk in _chunks(columns, MOMENT_CHUNK):
        if not chunk:
            continue
        aggs, med_aggs, structs = [], [], []
        for i, c in enumerate(chunk):
            x = as_double(c, df.schema[c].dataType)
            if not with_corr or target is None:
                corr = F.lit(None).cast("double")
            elif tgt_numeric:
                corr = pairwise_corr(x, tgt)
            else:
                corr = F.lit(0.0)
            aggs += [F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                     F.avg(x).alias(f"av{i}"),
                     F.stddev_samp(x).alias(f"sd{i}"), corrected_skew(x).alias(f"sk{i}"),
                     F.count_if(x.isNull()).alias(f"ms{i}"), corr.alias(f"cr{i}")]
            med_aggs.append(_median(x, mode).alias(f"md{i}"))
            structs.append(F.struct(
                F.lit(c).alias("column_name"),
                *[F.col(f"{p}{i}").alias(n) for p, n in
                  zip(["mn", "mx", "av", "md", "sd", "sk", "ms", "cr"], NUMERIC_PROFILE_COLS)]))
        if mode == "exact":
            moments = df.agg(*aggs, *[F.lit(meds[c]).cast("double").alias(f"md{i}")
                                      for i, c in enumerate(chunk)])
        else:
            # Sketch medians need object buffers, which would drag every
            # aggregate of the same node into the interpreted object-hash
            # path, so they are their own one-row aggregate.
            moments = df.agg(*aggs).crossJoin(df.agg(*med_aggs))
        parts.append(moments.select(F.inline(F.array(*structs))))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "column_name string, min double, max double, mean double, median double, "
                "std double, skew double, missing bigint, corr_target double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Q2 -------------------------------------------------------------------------

def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value, cnt) for every column and value, NULL included.

    One stack + one group; partial aggregation makes hot values cheap.
    """
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             as_category(c, df.schema[c].dataType).alias("value"))
                    for c in columns])
    return df.select(F.inline(arr)).groupBy("column_name", "value").agg(F.count("*").alias("cnt"))


def profile_categorical(df: DataFrame, columns: list[str] | None = None,
                        target: str | None = None) -> DataFrame:
    """Per categorical column: n_distinct, missing, most_common, most_common_count (Q2).

    Ties for the most common value go to the smallest value.
    """
    if columns is None:
        columns = infer_roles(df, target).categorical
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column_name string, n_distinct bigint, missing bigint, most_common string, "
                "most_common_count bigint")
    vc = value_counts(df, columns)
    present = F.col("value").isNotNull()
    per_col = vc.groupBy("column_name").agg(
        F.count_if(present).alias("n_distinct"),
        F.coalesce(F.sum(F.when(~present, F.col("cnt"))), F.lit(0)).cast("bigint").alias("missing"),
        F.min_by(F.when(present, F.col("value")),
                 F.when(present, F.struct(-F.col("cnt"), F.col("value")))).alias("most_common"),
        F.max(F.when(present, F.col("cnt"))).alias("most_common_count"))
    # One row per requested column even for an empty table (bounded by the
    # column count, so the per-column table is broadcast).
    names = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    return (names.join(F.broadcast(per_col), "column_name", "left")
            .select("column_name", F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
                    F.coalesce("missing", F.lit(0)).cast("bigint").alias("missing"),
                    "most_common", "most_common_count"))


# Q3 -------------------------------------------------------------------------

def profile_target_regression(df: DataFrame, target: str, median: str = "exact") -> DataFrame:
    """min, max, mean, median, std, skew of a numeric target (Q3)."""
    return (profile_numeric(df, None, [target], median=median, with_corr=False)
            .select("column_name", "min", "max", "mean", "median", "std", "skew"))


# Q4 -------------------------------------------------------------------------

def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(class, count) per non-missing target value."""
    t = as_category(target, df.schema[target].dataType)
    return (df.select(t.alias("class")).where(F.col("class").isNotNull())
            .groupBy("class").agg(F.count("*").alias("count")))


def profile_target_classes(df: DataFrame, target: str) -> DataFrame:
    """n_classes, most/least frequent class and their counts (Q4).

    Ties go to the smallest class value.
    """
    cc = class_counts(df, target)
    return cc.agg(
        F.count("*").alias("n_classes"),
        F.min_by("class", F.struct(-F.col("count"), F.col("class"))).alias("most_frequent"),
        F.max("count").alias("most_frequent_count"),
        F.min_by("class", F.struct(F.col("count"), F.col("class"))).alias("least_frequent"),
        F.min("count").alias("least_frequent_count"))


# Q5 -------------------------------------------------------------------------

def feature_stats(df: DataFrame, target: str | None = None, median: str = "exact") -> DataFrame:
    """Long table of all features: type + numeric or categorical subset (Q5)."""
    roles = infer_roles(df, target)
    num = profile_numeric(df, roles.target, roles.numeric, median=median, with_corr=False) \
        .drop("corr_target").withColumn("type", F.lit("numeric"))
    cat = profile_categorical(df, roles.categorical).withColumn("type", F.lit("categorical"))
    return num.unionByName(cat, allowMissingColumns=True)


# Q6 -------------------------------------------------------------------------

def correlation_ranking(df: DataFrame, target: str, columns: list[str] | None = None) -> DataFrame:
    """|corr| of numeric features with a numeric target, highest first (Q6)."""
    roles = infer_roles(df, target)
    cols = columns if columns is not None else roles.numeric
    tgt = as_double(target, df.schema[target].dataType)
    structs = [F.struct(F.lit(c).alias("column_name"),
                        F.abs(pairwise_corr(as_double(c, df.schema[c].dataType), tgt)).alias("abs_corr"))
               for c in cols]
    return (df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
            .orderBy(F.col("abs_corr").desc_nulls_last(), "column_name"))


# Q7 -------------------------------------------------------------------------

def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram between the column's own min and max (Q7).

    Columns: bin, lower, upper, count. The last bin is closed, empty bins are
    kept, and min = max widens the range to +-0.5. The bounds come from a
    one-row aggregate that is broadcast to the scan, so the binning needs no
    shuffle beyond the (partial) count.
    """
    x = as_double(column, df.schema[column].dataType)
    vals = df.select(x.alias("x")).where(F.col("x").isNotNull())
    rng = vals.agg(F.min("x").alias("mn0"), F.max("x").alias("mx0")).select(
        F.when(F.col("mn0") == F.col("mx0"), F.col("mn0") - 0.5).otherwise(F.col("mn0")).alias("lo"),
        F.when(F.col("mn0") == F.col("mx0"), F.col("mx0") + 0.5).otherwise(F.col("mx0")).alias("hi"))
    idx = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                  F.lit(bins - 1)).cast("int")
    counts = (vals.crossJoin(F.broadcast(rng)).select(idx.alias("bin"))
              .groupBy("bin").agg(F.count("*").alias("count")))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin")).crossJoin(F.broadcast(rng))
    width = (F.col("hi") - F.col("lo")) / bins
    return (grid.join(F.broadcast(counts), "bin", "left")
            .select("bin", (F.col("lo") + F.col("bin") * width).alias("lower"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))


# Q8 -------------------------------------------------------------------------

def category_frequencies(ref: DataFrame, cur: DataFrame, column: str) -> DataFrame:
    """Relative frequency of each category on both sides; absent = 0 (Q8).

    Columns: value, ref_freq, cur_freq (shares of the non-missing count).
    """
    from veritab.operators.drift import category_counts, category_shares
    shares = category_shares(category_counts(ref, cur, [column]))
    return shares.select("value",
                         F.coalesce(F.col("p_ref"), F.lit(0.0)).alias("ref_freq"),
                         F.coalesce(F.col("p_cur"), F.lit(0.0)).alias("cur_freq"))


# Q9 -------------------------------------------------------------------------

def distinct_rows(df: DataFrame) -> DataFrame:
    """One row: n_distinct, the number of different rows, missing values (NULL
    and NaN) being equal. Two independent 64-bit hashes of a row stand for it;
    each column is hashed with a mark of its being missing, since a hash of
    several columns passes over NULLs. Maps are compared by their JSON text."""
    parts = []
    for f in normalize_missing(df.limit(0)).schema.fields:
        c = qcol(f.name)
        parts += [c.isNull(), F.to_json(c) if isinstance(f.dataType, T.MapType) else c]
    base = normalize_missing(df)
    if not parts:
        return base.agg(F.least(F.count("*"), F.lit(1)).alias("n_distinct"))
    return (base.select(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(7), *parts[::-1]).alias("b")).distinct()
            .agg(F.count("*").alias("n_distinct")))


def quality_counts(df: DataFrame) -> DataFrame:
    """row_count, column_count, missing_cells, missing_pct, duplicate_rows (Q9).

    NaN counts as missing. Duplicates = rows - distinct rows, with missing
    values equal; rows are told apart by two 64-bit hashes, so 16 bytes of a
    row are shuffled, once per task for a row that is repeated a billion times.
    """
    ncols = len(df.columns)
    miss = [as_category(f.name, f.dataType).isNull().cast("int") for f in df.schema.fields]
    missing_expr = sum(miss[1:], miss[0]) if miss else F.lit(0)
    base = df.agg(F.count("*").alias("row_count"),
                  F.coalesce(F.sum(missing_expr), F.lit(0)).cast("bigint").alias("missing_cells"))
    distinct = distinct_rows(df)
    return base.crossJoin(distinct).select(
        "row_count", F.lit(ncols).cast("bigint").alias("column_count"), "missing_cells",
        (F.try_divide(F.col("missing_cells"), F.col("row_count") * ncols) * 100).alias("missing_pct"),
        (F.col("row_count") - F.col("n_distinct")).alias("duplicate_rows"))


# Q10 ------------------------------------------------------------------------

def dataset_summary(df: DataFrame, target: str | None = None, max_classes: int = 10) -> DataFrame:
    """n_samples, n_features, target, problem_type (Q10)."""
    from veritab.operators.schema import task_frame
    roles = infer_roles(df, target)
    task = task_frame(df, roles.target, max_classes).select("task")
    return (df.agg(F.count("*").alias("n_samples")).crossJoin(task)
            .select("n_samples", F.lit(len(df.columns) - 1).cast("bigint").alias("n_features"),
                    F.lit(roles.target).alias("target"), F.col("task").alias("problem_type")))
