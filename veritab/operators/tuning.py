"""Tuning: operators T1, T2, T4, T6 (T3/T5 are plans in ``veritab.plans.search``).

A parameter grid is a tiny table (its size is the product of the value list
lengths, known before any job runs); folds are a hash column on the data, so
cross-validation never materialises per-fold copies of the table.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.functions.exprs import keyed_hash32, qcol, whole_row_hash32

# Default grids of the reference (API defaults), per family.
DEFAULT_GRIDS = {
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20],
                      "min_samples_split": [2, 5, 10]},
    "svm": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"]},
    "neural_network": {"hidden_layer_sizes": [[50], [100], [50, 50]],
                       "activation": ["relu", "tanh"], "alpha": [0.0001, 0.001, 0.01]},
}
# Default ranges of the forest grid in the UI (min, max, step).
DEFAULT_RANGES = {
    "n_estimators": {"min": 10, "max": 100, "step": 10},
    "max_depth": {"min": 3, "max": 10, "step": 1},
    "min_samples_split": {"min": 2, "max": 10, "step": 2},
}


# T1 -------------------------------------------------------------------------

def range_values(r: dict) -> list:
    """{min, max, step} -> floor((max - min) / step) + 1 values from min."""
    n = int(math.floor((r["max"] - r["min"]) / r["step"])) + 1
    return [r["min"] + i * r["step"] for i in range(max(n, 0))]


def grid_dict(model_type: str, ranges: dict | None = None) -> dict[str, list]:
    """Value lists per parameter: from ``ranges`` if given, else the family default."""
    if ranges:
        return {k: (range_values(v) if isinstance(v, dict) else list(v)) for k, v in ranges.items()}
    if model_type not in DEFAULT_GRIDS:
        raise ValueError(f"unknown model type {model_type!r}")
    return {k: list(v) for k, v in DEFAULT_GRIDS[model_type].items()}


def grid_combinations(grid: dict[str, list]) -> list[dict]:
    """Cartesian product, keys sorted, last key varying fastest."""
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def param_grid(spark: SparkSession, model_type: str, ranges: dict | None = None) -> DataFrame:
    """T1 as a table: combo (0-based grid order) and params MAP<STRING,STRING>."""
    import json
    combos = grid_combinations(grid_dict(model_type, ranges))
    rows = [(i, {k: json.dumps(v) for k, v in c.items()}) for i, c in enumerate(combos)]
    return spark.createDataFrame(rows, "combo int, params map<string,string>")


# T2 -------------------------------------------------------------------------

#: Hash buckets of a class in stratified folds.
STRATIFY_BUCKETS = 4096


def assign_folds(df: DataFrame, k: int = 3, key: str | None = None, seed: int = 42,
                 fold_col: str = "fold", stratify: str | None = None) -> DataFrame:
    """Add an integer ``fold`` in [0, k) (T2); the column feeds
    ``CrossValidator(foldCol=...)`` or ``plans.search``.

    Default: the md5 hash of ``key`` modulo k (of the whole row without a key
    or where it is NULL) — no shuffle; classes are balanced across folds in
    expectation.

    ``stratify=col``: exactly stratified, as scikit-learn's classifier folds
    (per class, fold sizes differ by at most one; NULL is a class of its own).
    A row's rank inside its class, in hash order, is found without ranking a
    class in one task: counts per (class, hash bucket) give every bucket its
    starting rank, and rows are numbered only inside their bucket. fold = rank
    mod k. Rows that share a key, and so a hash, are numbered by the hash of
    the whole row; a large group of them is one cell, sorted with spilling.
    """
    h = keyed_hash32(df, key, seed)
    if stratify is None:
        return df.withColumn(fold_col, F.pmod(h, F.lit(k)).cast("int"))
    cls = qcol(stratify).cast("string")
    tagged = (df.withColumn("__h", h).withColumn("__t", whole_row_hash32(df, seed + 1))
              .withColumn("__s", F.coalesce(F.concat(F.lit("="), cls), F.lit("")))
              .withColumn("__b", F.shiftright("__h", 20).cast("int")))
    cells = tagged.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    starts = cells.withColumn(
        "__c0", F.sum("__n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__n")).drop("__n")
    within = Window.partitionBy("__s", "__b").orderBy("__h", *([qcol(key)] if key else []), "__t")
    out = (tagged.join(starts, ["__s", "__b"])
           .withColumn(fold_col, F.pmod(F.col("__c0") + F.row_number().over(within) - 1,
                                        F.lit(k)).cast("int")))
    return out.select(*[qcol(c) for c in df.columns if c != fold_col], fold_col)


#: Classes whose fold boundaries the driver holds (a few numbers each).
MAX_STRATA = 20_000
#: Bits of the row key that one round of counting decides: 63 in four rounds.
ROUND_SHIFTS = (47, 31, 15, 0)


def fold_places(df: DataFrame, key: str | None = None, seed: int = 42, stratify: str | None = None) -> DataFrame:
    """``df`` with what ``boundary_folds`` reads of a row in every round, its
    place and its class, so that a caller can keep them."""
    place = keyed_hash32(df, key, seed).cast("bigint") * (1 << 31) + F.shiftright(whole_row_hash32(df, seed + 1).cast("bigint"), 1)
    cls = F.lit("") if stratify is None else F.coalesce(F.concat(F.lit("="), qcol(stratify).cast("string")), F.lit(""))
    return df.withColumn("__place", place).withColumn("__class", cls)


def boundary_folds(df: DataFrame, k: int = 3, key: str | None = None, seed: int = 42, fold_col: str = "fold",
                   stratify: str | None = None, placed: bool = False) -> DataFrame:
    """Folds of exact sizes without moving a row (T2): within each class of
    ``stratify`` (all rows without it; NULL is a class), fold sizes differ by at
    most one, and the larger folds change from class to class.

    A row's place is its 63-bit key: the md5 hash of ``key``, then a hash of
    the whole row, so that one key may hold any share of the rows. The k - 1
    keys that part a class into folds are order statistics, found for all
    classes at once by counting: rounds of 16 bits, each over the rows that
    share the bits found so far. A fold is then a comparison. Only identical
    rows at such a key are told apart by number; they alone are exchanged.
    ``placed``: ``df`` is from ``fold_places``.
    """
    tagged = df if placed else fold_places(df, key, seed, stratify)
    names = [c for c in tagged.columns if c not in ("__place", "__class")]
    sizes = tagged.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).limit(MAX_STRATA + 1).collect()
    if len(sizes) > MAX_STRATA:
        raise ValueError(f"{stratify!r} has more than {MAX_STRATA} classes to stratify by")
    spark = df.sparkSession
    # (class, boundary) -> rows still to pass, and the bits found so far
    found = {(r["__class"], f): (f * r["n"] // k, 0, 0) for r in sizes for f in range(1, k)}
    before = 63
    for shift in ROUND_SHIFTS if found else ():
        prefixes = sorted({(c, bits) for (c, _), (_, bits, _) in found.items()})
        wanted = spark.createDataFrame(prefixes, "__class string, __bits bigint")
        cells = (tagged.withColumn("__bits", F.shiftright("__place", before) if before < 63 else F.lit(0).cast("bigint"))
                 .join(F.broadcast(wanted), ["__class", "__bits"])
                 .groupBy("__class", "__bits", F.shiftright("__place", shift).alias("next")).agg(F.count(F.lit(1)).alias("n")))
        # the cell in which each boundary lies: counts up to it, per prefix
        order = Window.partitionBy("__class", "__bits").orderBy("next")
        cells = cells.withColumn("upto", F.sum("n").over(order))
        goals = spark.createDataFrame([(c, f, need, bits) for (c, f), (need, bits, _) in found.items()],
                                      "__class string, f int, need bigint, __bits bigint")
        hits = (cells.join(F.broadcast(goals), ["__class", "__bits"])
                .where((F.col("upto") > F.col("need")) & (F.col("upto") - F.col("n") <= F.col("need"))))
        for r in hits.select("__class", "f", "need", "next", "n", "upto").collect():
            found[r["__class"], r["f"]] = (r["need"] - (r["upto"] - r["n"]), r["next"], r["n"])
        before = shift
    # a class's boundaries: the key, and how many of the rows equal to it lie before
    at, before = [f"__at{f}" for f in range(1, k)], [f"__before{f}" for f in range(1, k)]
    table = [(r["__class"], *[x for f in range(1, k) for x in (found[r["__class"], f][1], found[r["__class"], f][0])]) for r in sizes]
    bounds = spark.createDataFrame(table, ", ".join(["__class string", *[f"{a} bigint, {b} bigint" for a, b in zip(at, before)]]))
    turn = F.conv(F.substring(F.md5(F.col("__class").cast("binary")), 1, 8), 16, 10).cast("bigint")
    rows = tagged.join(F.broadcast(bounds.withColumn("__turn", turn)), "__class")

    def fold(number):
        place = F.col("__place")
        passed = [((place > F.col(a)) | ((place == F.col(a)) & (number >= F.col(b)))).cast("int") for a, b in zip(at, before)]
        return F.pmod(sum(passed, F.col("__turn")), F.lit(k)).cast("int")

    ties = sorted({(c, bits) for (c, _), (need, bits, n) in found.items() if need > 0})
    if not ties:
        return rows.select(*map(qcol, [c for c in names if c != fold_col]), fold(F.lit(0)).alias(fold_col))
    tied = spark.createDataFrame(ties, "__class string, __place bigint")
    others = rows.join(F.broadcast(tied), ["__class", "__place"], "left_anti").withColumn("__number", F.lit(0).cast("bigint"))
    same = rows.join(F.broadcast(tied), ["__class", "__place"]).withColumn("__part", F.spark_partition_id())
    parts = same.groupBy("__class", "__place", "__part").agg(F.count(F.lit(1)).alias("n"))
    starts = parts.withColumn("__start", F.sum("n").over(Window.partitionBy("__class", "__place").orderBy("__part")) - F.col("n")).drop("n")
    within = Window.partitionBy("__class", "__place", "__part").orderBy("__part")
    same = (same.withColumn("__nth", F.row_number().over(within) - 1).join(F.broadcast(starts), ["__class", "__place", "__part"])
            .withColumn("__number", F.col("__start") + F.col("__nth")))
    keep = [qcol(c) for c in names if c != fold_col]
    return (others.select(*keep, fold(F.col("__number")).alias(fold_col))
            .unionByName(same.select(*keep, fold(F.col("__number")).alias(fold_col))))


# T4 -------------------------------------------------------------------------

def rank_results(scores: DataFrame, combo: str = "combo", score: str = "score") -> DataFrame:
    """Per combination: mean_test_score, std_test_score (population std over
    folds), rank_test_score (competition rank, ties share the lowest) (T4).

    ``scores`` has one row per (combination, fold); its size is grid x folds.
    """
    agg = scores.groupBy(combo).agg(F.avg(score).alias("mean_test_score"),
                                    F.stddev_pop(score).alias("std_test_score"))
    w = Window.orderBy(F.col("mean_test_score").desc())
    return agg.withColumn("rank_test_score", F.rank().over(w).cast("int"))


def best_result(ranked: DataFrame, combo: str = "combo") -> DataFrame:
    """The best row; among equal means the first combination in grid order."""
    return ranked.orderBy(F.col("mean_test_score").desc(), F.col(combo).asc()).limit(1)


# T6 -------------------------------------------------------------------------

def random_search(grid: DataFrame, n: int, seed: int = 42, combo: str = "combo") -> DataFrame:
    """``n`` combinations drawn without replacement, reproducibly."""
    return grid.orderBy(F.xxhash64(F.col(combo), F.lit(seed)), combo).limit(n)
