"""Preparation: operators P1-P6 (P7 is a plan in ``veritab.plans.prepare``).

Fitted parameters (means, stds, category lists, label lists) are small
and bounded: a one-row aggregate, or a category list collected under an
explicit size guard. Applying them is always a projection, never a join with
a table that grows with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.exprs import TWO_POW_32, as_category, as_double, keyed_hash32, qcol
from veritab.operators.schema import normalize_missing

MAX_CATEGORIES = 1000   # per column, for dense one-hot columns
MAX_LABELS = 10_000     # label encoder size guard


# P1 -------------------------------------------------------------------------

def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (NaN counts as missing)."""
    return normalize_missing(df).na.drop("any", subset=subset)


# P2 -------------------------------------------------------------------------

def fit_standardizer(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: mean and population std per column (``<c>__mean``, ``<c>__std``)."""
    aggs = []
    for c in cols:
        x = as_double(c, df.schema[c].dataType)
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_pop(x).alias(f"{c}__std")]
    return df.agg(*aggs)


def apply_standardizer(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    """z = (x - mean) / std, std 0 -> divide by 1; NULL stays NULL.

    ``params`` is one row; it is fetched once and its values become literals,
    so later actions don't compute it again.
    """
    fitted = params.select(*[qcol(f"{c}__{kind}") for c in cols for kind in ("mean", "std")]).first()
    out = []
    for f in df.schema.fields:
        if f.name in cols:
            mean, sd = fitted[2 * cols.index(f.name)], fitted[2 * cols.index(f.name) + 1]
            out.append(((as_double(f.name, f.dataType) - F.lit(mean).cast("double")) / F.lit(sd or 1.0)).alias(f.name))
        else:
            out.append(qcol(f.name))
    return df.select(*out)


def standardize(df: DataFrame, cols: list[str], fit_df: DataFrame | None = None) -> DataFrame:
    """Z-score with population std (P2); fit on ``fit_df`` (default: ``df``)."""
    if not cols:
        return df
    return apply_standardizer(df, fit_standardizer(fit_df if fit_df is not None else df, cols), cols)


# P3 / P4 ---------------------------------------------------------------------

def fit_categories(df: DataFrame, cols: list[str], max_categories: int = MAX_CATEGORIES,
                   on_wide: str = "raise") -> dict[str, list]:
    """Sorted distinct categories per column, NULL last (as ``None``).

    A sketch of the distinct counts keeps columns that are far too wide out of
    the one stack + distinct job, whose result is therefore bounded. Columns
    with more than ``max_categories`` raise, or with ``on_wide='skip'`` are
    left out for ``one_hot_vector``.
    """
    if not cols:
        return {}
    values = {c: as_category(c, df.schema[c].dataType) for c in cols}
    sketch = df.agg(*[F.approx_count_distinct(v, 0.02).alias(f"n{i}") for i, v in enumerate(values.values())]).first()
    out: dict[str, list] = {c: [] for i, c in enumerate(cols) if sketch[i] <= 1.5 * max_categories}
    if out:
        arr = F.array(*[F.struct(F.lit(c).alias("k"), values[c].alias("v")) for c in out])
        for r in df.select(F.inline(arr)).distinct().collect():
            out[r["k"]].append(r["v"])
    out = {c: vals for c, vals in out.items() if len(vals) <= max_categories}
    wide = [c for c in cols if c not in out]
    if wide and on_wide == "raise":
        raise ValueError(f"columns {wide} have more than {max_categories} categories; "
                         f"use one_hot_vector for wide columns")
    return {c: sorted(v for v in vals if v is not None) + [None] * (None in vals) for c, vals in out.items()}


def _dummy_names(col: str, cats: list) -> list[str]:
    """One name per category; a NULL next to the text 'nan' gets underscores
    until its name is free."""
    names = [f"{col}_{c}" for c in cats if c is not None]
    missing = f"{col}_nan"
    while missing in names:
        missing += "_"
    return [missing if c is None else f"{col}_{c}" for c in cats]


def apply_one_hot(df: DataFrame, categories: dict[str, list], drop_first: bool = False) -> DataFrame:
    """Replace each encoded column by one 0/1 DOUBLE column per category.

    Remaining columns keep their order; encoded columns are appended column by
    column. Unseen values give all zeros. With ``drop_first`` the first sorted
    category is left out and NULL is all zeros.
    """
    cols = list(categories)
    keep = [qcol(c) for c in df.columns if c not in categories]
    new = []
    for c in cols:
        v = as_category(c, df.schema[c].dataType)
        cats = categories[c]
        if drop_first:
            cats = [x for x in cats if x is not None][1:]
        for cat, name in zip(cats, _dummy_names(c, cats)):
            hit = v.isNull() if cat is None else (v == F.lit(cat))
            new.append(F.coalesce(hit, F.lit(False)).cast("double").alias(name))
    return df.select(*keep, *new)


def one_hot(df: DataFrame, cols: list[str], max_categories: int | None = None,
            fit_df: DataFrame | None = None) -> DataFrame:
    """One-hot encoding, NULL as its own ``<col>_nan`` category.

    Columns with more than ``MAX_CATEGORIES`` values become one sparse vector
    ``<col>_vec`` each; with ``max_categories`` given, wider ones are an error.
    """
    fit_on = fit_df if fit_df is not None else df
    if max_categories is not None:
        return apply_one_hot(df, fit_categories(fit_on, cols, max_categories))
    narrow = fit_categories(fit_on, cols, on_wide="skip")
    out = apply_one_hot(df, narrow)
    wide = [c for c in cols if c not in narrow]
    return one_hot_vector(out, wide, fit_df=fit_on) if wide else out


def one_hot_drop_first(df: DataFrame, cols: list[str], max_categories: int | None = None) -> DataFrame:
    """One-hot without the first sorted category; NULL -> all zeros.
    Wide columns as in ``one_hot``."""
    if max_categories is not None:
        return apply_one_hot(df, fit_categories(df, cols, max_categories), drop_first=True)
    narrow = fit_categories(df, cols, on_wide="skip")
    out = apply_one_hot(df, narrow, drop_first=True)
    wide = [c for c in cols if c not in narrow]
    return one_hot_vector(out, wide, drop_first=True, fit_df=df) if wide else out


def sorted_codes(values: DataFrame) -> DataFrame:
    """(value, code): the rank 0..k-1 of every distinct non-null ``value``, in
    the order of its type, at any number of values.

    Distinct values are dealt by ranges and written to the checkpoint folder,
    so that the ranges stay as they are; the counts of the ranges before give
    each its first code, and values are numbered inside their range.
    """
    from veritab.session import checkpoint_dir
    checkpoint_dir(values.sparkSession)
    placed = (values.where(F.col("value").isNotNull()).select("value").distinct().repartitionByRange("value")
              .withColumn("part", F.spark_partition_id()).checkpoint())
    starts = (placed.groupBy("part").agg(F.count("*").alias("n"))
              .select(F.col("part").alias("of"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start")))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("value"))
    return placed.join(F.broadcast(starts), F.col("part") == F.col("of")).select("value", (F.col("start") + nth - 1).alias("code"))


def category_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the rank 0..k-1 of every distinct non-missing value, as
    text, in sorted order."""
    return sorted_codes(df.select(as_category(column, df.schema[column].dataType).alias("value")))


def one_hot_vector(df: DataFrame, cols: list[str], drop_last: bool = False, fit_df: DataFrame | None = None,
                   drop_first: bool = False) -> DataFrame:
    """Wide-column path of P3 and P4: sparse one-hot vectors ``<col>_vec`` in
    place of the columns.

    Slots are in the sorted order of the values (``category_codes`` of
    ``fit_df``, default ``df``), whatever their number; codes are joined by
    value. NULL and values unseen at fit time share one extra last slot. With
    ``drop_first`` the first value, NULL and unseen ones are all zeros.
    """
    from pyspark.ml.feature import OneHotEncoder
    out, keep = df, [c for c in df.columns if c not in cols]
    for i, c in enumerate(cols):
        source = fit_df if fit_df is not None else df
        codes = category_codes(source, c).select(F.col("value").alias(f"__v{i}"), F.col("code").alias(f"__c{i}"))
        n = codes.count()
        code, slots = F.col(f"__c{i}"), n + 1
        if drop_first:  # the encoder drops the last slot, which stands for all that is zero
            code, n, slots = F.when(code > 0, code - 1), max(n - 1, 0), max(n, 1)
        meta = {"ml_attr": {"type": "nominal", "num_vals": slots, "name": f"__i{i}"}}
        out = (out.join(codes, as_category(c, df.schema[c].dataType) == F.col(f"__v{i}"), "left")
               .withColumn(f"__i{i}", F.coalesce(code, F.lit(n)).cast("double")).withMetadata(f"__i{i}", meta))
    encoder = OneHotEncoder(inputCols=[f"__i{i}" for i in range(len(cols))], outputCols=[f"__o{i}" for i in range(len(cols))],
                            dropLast=drop_last or drop_first, handleInvalid="error")
    return encoder.fit(out).transform(out).select(*[qcol(c) for c in keep],
                                                  *[F.col(f"__o{i}").alias(f"{c}_vec") for i, c in enumerate(cols)])


# P5 -------------------------------------------------------------------------

class TooManyLabels(ValueError):
    """More distinct labels than a list in the plan should hold."""


def fit_labels(df: DataFrame, col: str, max_labels: int = MAX_LABELS) -> list:
    """Sorted distinct non-null values of ``col`` (natural order of its type)."""
    rows = (df.select(qcol(col).alias("v")).where(F.col("v").isNotNull()).distinct()
            .orderBy("v").limit(max_labels + 1).collect())
    if len(rows) > max_labels:
        raise TooManyLabels(f"{col!r} has more than {max_labels} distinct labels")
    return [r["v"] for r in rows]


def label_expr(col: Column, labels: list) -> Column:
    """Label -> index 0..k-1 through a literal map (JVM side, no join)."""
    if not labels:
        return F.lit(None).cast("int")
    m = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
    return F.element_at(m, col)


def inverse_label_expr(idx: Column, labels: list) -> Column:
    """Index -> original label."""
    if not labels:
        return F.lit(None)
    return F.element_at(F.array(*[F.lit(v) for v in labels]), idx.cast("int") + 1)


def label_table(df: DataFrame, col: str) -> DataFrame:
    """(value, code) of every distinct non-null value of ``col`` in the order
    of its type, at any number of them (P5 beyond ``MAX_LABELS``)."""
    return sorted_codes(df.select(qcol(col).alias("value")))


def encode_by_table(df: DataFrame, col: str, table: DataFrame, out_col: str | None = None) -> DataFrame:
    """Replace ``col`` by its code; NULL and unknown values are NULL."""
    out_col = out_col or col
    codes = table.select(F.col("value").alias("__label_value"), F.col("code").alias("__label_code"))
    joined = df.join(codes, qcol(col) == F.col("__label_value"), "left")
    keep = [F.col("__label_code").alias(c) if c == out_col else qcol(c) for c in df.columns]
    return joined.select(*keep, *([] if out_col in df.columns else [F.col("__label_code").alias(out_col)]))


def decode_by_table(df: DataFrame, col: str, table: DataFrame, out_col: str | None = None) -> DataFrame:
    """The inverse: replace codes by their values."""
    return encode_by_table(df, col, table.select(F.col("code").alias("value"), F.col("value").alias("code")), out_col)


def label_encode(df: DataFrame, col: str, out_col: str | None = None, labels: list | None = None,
                 max_labels: int = MAX_LABELS) -> tuple[DataFrame, list | DataFrame]:
    """Replace ``col`` by its index among the sorted distinct values (P5).

    Also returns the labels: a list, or with more than ``max_labels`` of them
    the table (value, code) that they were joined from (``decode_by_table``)."""
    if labels is None:
        try:
            labels = fit_labels(df, col, max_labels)
        except TooManyLabels:
            table = label_table(df, col)
            return encode_by_table(df, col, table, out_col), table
    out_col = out_col or col
    if out_col == col:
        cols = [label_expr(qcol(c), labels).alias(c) if c == col else qcol(c) for c in df.columns]
    else:
        cols = [qcol(c) for c in df.columns if c != out_col]
        cols.append(label_expr(qcol(col), labels).alias(out_col))
    return df.select(*cols), labels


# P6 -------------------------------------------------------------------------

def split_hash(df: DataFrame, key: str | None = None, seed: int = 42) -> Column:
    """md5-based hash of ``key`` (checkable in SQL), else, and for a NULL key,
    a native hash of the row."""
    return keyed_hash32(df, key, seed)


def train_size_for(n: int, ratio: float) -> int:
    """Train rows for ``n`` rows at ``ratio``: n - ceil((1 - ratio) * n)."""
    return n - int(math.ceil(round((1.0 - ratio) * n, 9)))


def train_test_split(df: DataFrame, ratio: float = 0.8, seed: int = 42, key: str | None = None,
                     exact: bool = False, split_col: str = "split") -> DataFrame:
    """Add ``split`` = 'train' / 'test' (P6).

    Default: a row goes to train when its 32-bit md5 hash of ``key`` (or of
    the whole row) is below ``ratio * 2^32``: no shuffle, no sort, the same
    answer on every re-execution, sizes approximate.

    ``exact=True`` reproduces the reference's train size n - ceil((1-r) n):
    a 65,536-bucket histogram of the hash (a partial aggregate, collected:
    bounded by 65,536 rows) finds the boundary bucket, a second histogram of
    the low 16 bits inside it finds the boundary hash value, and only the
    rows sharing that one hash value are told apart by key.
    """
    h = split_hash(df, key, seed)
    if not exact:
        return df.withColumn(split_col, F.when(h < F.lit(ratio * TWO_POW_32), "train").otherwise("test"))

    tagged = df.withColumn("__h", h)
    hi = tagged.groupBy(F.shiftright("__h", 16).alias("b")).count().collect()
    n = sum(r["count"] for r in hi)
    want = train_size_for(n, ratio)
    if want <= 0 or want >= n:
        return tagged.withColumn(split_col, F.lit("train" if want >= n else "test")).drop("__h")
    cum = 0
    bucket = None
    for r in sorted(hi, key=lambda r: r["b"]):
        if cum + r["count"] >= want:
            bucket = r["b"]
            break
        cum += r["count"]
    need = want - cum
    lo = (tagged.where(F.shiftright("__h", 16) == bucket)
          .groupBy(F.col("__h").bitwiseAND(0xFFFF).alias("l")).count().collect())
    cum2 = 0
    hval = None
    for r in sorted(lo, key=lambda r: r["l"]):
        if cum2 + r["count"] >= need:
            hval = (bucket << 16) | r["l"]
            break
        cum2 += r["count"]
    ties_needed = need - cum2
    # Only the rows that share the boundary hash value are ranked; everything
    # else is decided by a comparison, with no shuffle.
    rest = tagged.where(F.col("__h") != hval).withColumn(
        split_col, F.when(F.col("__h") < hval, "train").otherwise("test"))
    # Tied rows go by key: the keys of one 32-bit hash value are a handful, so
    # their counts are collected. Rows of the last key taken (or, without keys,
    # identical rows) may be a third of the table; they are interchangeable, so
    # each input partition contributes a quota and numbers its own rows.
    ties = tagged.where(F.col("__h") == hval)
    same, before, left = F.lit(True), F.lit(False), ties_needed
    if key:
        counts = ties.groupBy(qcol(key).alias("k")).count().orderBy(F.col("k").asc_nulls_first()).collect()
        for r in counts:
            if r["count"] >= left:
                break
            left -= r["count"]
        same = qcol(key).eqNullSafe(F.lit(r["k"]))
        before = F.lit(False) if r["k"] is None else qcol(key).isNull() | (qcol(key) < F.lit(r["k"]))
    settled = ties.where(~same).withColumn(split_col, F.when(before, "train").otherwise("test"))
    last = (ties.where(same).withColumn("__p", F.spark_partition_id())
            .withColumn("__i", F.monotonically_increasing_id()))
    quota = []
    for r in last.groupBy("__p").count().orderBy("__p").collect():
        quota.append((r["__p"], min(left, r["count"])))
        left -= quota[-1][1]
    shares = df.sparkSession.createDataFrame(quota, "__p int, __q long")
    last = (last.withColumn("__rn", F.row_number().over(Window.partitionBy("__p").orderBy("__i")))
            .join(F.broadcast(shares), "__p")
            .withColumn(split_col, F.when(F.col("__rn") <= F.col("__q"), "train").otherwise("test")))
    names = [qcol(c) for c in [*df.columns, split_col]]
    return rest.select(*names).union(settled.select(*names)).union(last.select(*names))
