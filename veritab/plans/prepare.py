"""The preparation plan C0 -> C1 -> P1 -> P2 -> P3 -> P5 -> P6.

The result is one lazy DataFrame (features, encoded target, ``split``) plus
the small fitted parameters and a one-row statistics table. Fitting touches
the data twice (one aggregate for means/stds, one distinct job for the
category and label lists); the application is a single projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import is_numeric_type, qcol
from veritab.operators import prep
from veritab.operators.schema import feature_list_label, infer_roles, normalize_missing
from veritab.session import guard_wide_plan

# Step names the reference's preparation accepts.
STEP_DROP_NULLS = ("drop_nulls", "handle_missing_values")
STEP_SCALE = ("normalize", "standardize")
STEP_ONE_HOT = ("one_hot_encode",)
KNOWN_STEPS = STEP_DROP_NULLS + STEP_SCALE + STEP_ONE_HOT


@dataclass
class Prepared:
    data: DataFrame                 # features..., target (encoded), split
    stats: DataFrame                # one row of dataset statistics
    target: str
    features: list[str]
    numeric: list[str]
    categorical: list[str]
    task_labels: list | DataFrame | None = None  # label encoder classes, a table of many (None: numeric target)
    scaler: DataFrame | None = None
    categories: dict = field(default_factory=dict)


def prepare(df: DataFrame, steps=("drop_nulls", "normalize", "one_hot_encode"),
            ratio: float = 0.8, target: str | None = None, key: str | None = None,
            seed: int = 42, exact: bool = False, fit_on: str = "all",
            max_categories: int = prep.MAX_CATEGORIES) -> Prepared:
    """Prepare a table for training.

    ``fit_on='all'`` fits scaler and encoder on all rows before the split (the
    reference's behaviour); ``fit_on='train'`` fits on the train rows only.
    Categorical columns with more than ``max_categories`` values become one
    sparse vector column ``<col>_vec`` each instead of that many columns.
    Unknown step names raise.
    """
    unknown = [s for s in steps if s not in KNOWN_STEPS]
    if unknown:
        raise ValueError(f"unknown preprocessing steps {unknown}; known: {list(KNOWN_STEPS)}")
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    raw = df
    guard_wide_plan(df.sparkSession, len(df.columns))
    df = normalize_missing(df)
    roles = infer_roles(df, target)
    tgt = roles.target
    if any(s in STEP_DROP_NULLS for s in steps):
        df = df.na.drop("any", subset=roles.features + [tgt])

    # The split depends only on the key (or row), so it is assigned first and
    # the train rows are available for fit_on='train'.
    df = prep.train_test_split(df, ratio, seed=seed, key=key, exact=exact)
    fit_df = df.where(F.col("split") == "train") if fit_on == "train" else df

    scaler = None
    if any(s in STEP_SCALE for s in steps) and roles.numeric:
        scaler = prep.fit_standardizer(fit_df, roles.numeric)
        df = prep.apply_standardizer(df, scaler, roles.numeric)
    categories = {}
    if any(s in STEP_ONE_HOT for s in steps) and roles.categorical:
        categories = prep.fit_categories(fit_df, roles.categorical, max_categories, on_wide="skip")
        wide = [c for c in roles.categorical if c not in categories]
        df = prep.apply_one_hot(df, categories)
        if wide:
            df = prep.one_hot_vector(df, wide, fit_df=fit_df)

    labels = None
    if not is_numeric_type(df.schema[tgt].dataType):
        df, labels = prep.label_encode(df, tgt)

    features = [c for c in df.columns if c not in (tgt, "split")]
    data = df.select(*[qcol(c) for c in features], qcol(tgt), "split")
    stats = dataset_stats(raw, data, tgt, features, roles.categorical, roles.numeric)
    return Prepared(data, stats, tgt, features, roles.numeric, roles.categorical, labels,
                    scaler, categories)


def dataset_stats(raw: DataFrame, data: DataFrame, target: str, features: list[str],
                  categorical: list[str], numeric: list[str], max_names: int | None = None) -> DataFrame:
    """rows, columns (before dropping), train_size, test_size, features (all,
    or the first ``max_names`` and '...'), target, num_features,
    categorical_features, numerical_features."""
    sizes = data.agg(F.count_if(F.col("split") == "train").alias("train_size"),
                     F.count_if(F.col("split") == "test").alias("test_size"))
    return (raw.agg(F.count("*").alias("rows")).crossJoin(sizes)
            .select("rows", F.lit(len(raw.columns)).cast("bigint").alias("columns"),
                    "train_size", "test_size",
                    F.array(*[F.lit(x) for x in feature_list_label(features, max_names)]).alias("features"),
                    F.lit(target).alias("target"),
                    F.lit(len(features)).cast("bigint").alias("num_features"),
                    F.lit(len(categorical)).cast("bigint").alias("categorical_features"),
                    F.lit(len(numeric)).cast("bigint").alias("numerical_features")))
