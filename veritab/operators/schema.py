"""Schema and role inference: operators C0-C6.

All of these are projections or plain schema walks; only ``infer_task``
runs a (bounded) job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import FLOAT_TYPES, is_numeric_type, qcol

_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


@dataclass
class Roles:
    """Column mapping of a table: target plus numeric and categorical features."""
    target: str | None
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical


# C0 -------------------------------------------------------------------------

def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL on every FLOAT/DOUBLE column; other columns untouched."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            cols.append(F.nanvl(qcol(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(qcol(f.name))
    return df.select(*cols)


# C1 -------------------------------------------------------------------------

def column_role(dt: T.DataType) -> str | None:
    """'numeric', 'categorical', or None for nested columns (excluded)."""
    if isinstance(dt, _NESTED):
        return None
    return "numeric" if is_numeric_type(dt) else "categorical"


def infer_roles(df: DataFrame, target: str | None = None) -> Roles:
    """Target = given, else a column named ``target``, else the last column.

    Features keep their input order; nested columns are left out.
    """
    cols = df.columns
    if target is None:
        target = "target" if "target" in cols else (cols[-1] if cols else None)
    elif target not in cols:
        raise ValueError(f"target column {target!r} not in {cols}")
    roles = Roles(target=target)
    for f in df.schema.fields:
        if f.name == target:
            continue
        r = column_role(f.dataType)
        if r == "numeric":
            roles.numeric.append(f.name)
        elif r == "categorical":
            roles.categorical.append(f.name)
    return roles


def roles_table(df: DataFrame, target: str | None = None) -> DataFrame:
    """C1 as a table: one row per column with its role and non-null count.

    The counts come from one aggregate pass, so the table reflects the data.
    """
    roles = infer_roles(df, target)
    role_of = {c: "numeric" for c in roles.numeric}
    role_of.update({c: "categorical" for c in roles.categorical})
    if roles.target is not None:
        role_of[roles.target] = "target"
    names = [f.name for f in df.schema.fields if f.name in role_of]
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"),
                        F.lit(role_of[c]).alias("role"),
                        F.count(qcol(c)).alias("non_null"))
               for i, c in enumerate(names)]
    return df.agg(F.array(*structs).alias("r")).select(F.inline("r"))


# C2 -------------------------------------------------------------------------

def task_frame(df: DataFrame, target: str, max_classes: int = 10) -> DataFrame:
    """One row (target, n_distinct_capped, task) as a lazy DataFrame.

    Classification if the target is non-numeric or has at most ``max_classes``
    distinct non-null values. The count is capped at ``max_classes + 1`` and
    exact up to there. A numeric target is sketched first: one with many times
    more values (a continuous one) never has them shuffled.
    """
    dt = df.schema[target].dataType
    numeric = is_numeric_type(dt)
    vals = df.select(qcol(target).alias("v")).where(F.col("v").isNotNull())
    if isinstance(dt, FLOAT_TYPES):
        vals = vals.where(~F.isnan("v"))
    if numeric and vals.agg(F.approx_count_distinct("v", 0.02)).first()[0] > 4 * max_classes + 100:
        capped = df.sparkSession.range(1).select(F.lit(max_classes + 1).cast("bigint").alias("n_distinct_capped"))
    else:
        capped = vals.distinct().limit(max_classes + 1).agg(F.count("*").alias("n_distinct_capped"))
    task = (F.lit("classification") if not numeric else
            F.when(F.col("n_distinct_capped") <= max_classes, "classification")
            .otherwise("regression"))
    return capped.select(F.lit(target).alias("target"), "n_distinct_capped",
                         task.alias("task"))


def infer_task(df: DataFrame, target: str, max_classes: int = 10) -> str:
    """'classification' or 'regression' for ``target`` (runs one bounded job)."""
    if not is_numeric_type(df.schema[target].dataType):
        return "classification"
    return task_frame(df, target, max_classes).first()["task"]


# C3 -------------------------------------------------------------------------

def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Columns present in both tables, sorted."""
    return sorted(set(a.columns) & set(b.columns))


def align_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both tables on their common columns, stacked with a ``side`` column.

    Categorical columns of the reference side are cast to string on both
    sides so the union has one type per column.
    """
    cols = common_columns(a, b)
    def proj(df: DataFrame, side: str) -> DataFrame:
        out = []
        for c in cols:
            ra, rb = a.schema[c].dataType, b.schema[c].dataType
            if is_numeric_type(ra) and is_numeric_type(rb):
                out.append(qcol(c).cast("double").alias(c))
            else:
                out.append(qcol(c).cast("string").alias(c))
        return df.select(*out, F.lit(side).alias("side"))
    return proj(a, "reference").unionByName(proj(b, "current"))


# C4 -------------------------------------------------------------------------

def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features, target) projections (C4)."""
    return df.drop(target), df.select(qcol(target))


def features_and_label(df: DataFrame, target: str, label: str = "label") -> DataFrame:
    """Features in input order followed by the target renamed to ``label``."""
    feats = [qcol(c) for c in df.columns if c != target]
    return df.select(*feats, qcol(target).alias(label))


# C5 -------------------------------------------------------------------------

def first_n_numeric(df: DataFrame, n: int = 5, exclude: tuple[str, ...] = ()) -> list[str]:
    """First ``n`` numeric columns in input order."""
    out = [f.name for f in df.schema.fields
           if is_numeric_type(f.dataType) and f.name not in exclude]
    return out[:n]


def feature_list_label(names: list[str], cap: int | None = None) -> list[str]:
    """Feature names; with ``cap`` only the first ones, and a trailing '...'
    marker if there are more (C5)."""
    return names if cap is None or len(names) <= cap else [*names[:cap], "..."]


# C6 -------------------------------------------------------------------------

def append_columns(df: DataFrame, new_cols: dict[str, Column]) -> DataFrame:
    """Column-wise concat: keep all columns, append new ones at the end.

    A projection, never a join by row index.
    """
    return df.select("*", *[c.alias(n) for n, c in new_cols.items()])
