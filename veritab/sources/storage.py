"""Sinks: prepared tables (S5) and the runs table with saved models.

Everything is written as parquet under a shared folder (by default the
cluster's ``spark.checkpoint.dir``), so a lost executor or a new driver can
read it back; nothing lives in driver memory between steps.
"""

from __future__ import annotations

import json
import os
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.session import checkpoint_dir


def store_root(spark: SparkSession, root: str | None = None) -> str:
    return root or os.path.join(checkpoint_dir(spark), "veritab-store")


def _prepared_base(spark: SparkSession, name: str, root: str | None) -> str:
    return os.path.join(store_root(spark, root), "prepared", name)


def save_prepared(df: DataFrame, name: str, params: dict[str, DataFrame] | None = None,
                  root: str | None = None, split_col: str = "split", spec: dict | None = None) -> str:
    """Write the split table partitioned by ``split``, its fitted parameter
    tables and ``spec`` (target, features, label classes, categories; anything
    that JSON holds) as a new version, and publish it (S5). Returns the folder.

    A version is a folder of its own; one small manifest, written last, makes
    it the current one. Readers follow the newest whole manifest, so a write
    that breaks leaves the version before it as it was, and a reader that has
    begun keeps the files of its version.
    """
    spark = df.sparkSession
    base = _prepared_base(spark, name, root)
    version = uuid.uuid4().hex
    folder = os.path.join(base, "versions", version)
    w = df.write
    if split_col in df.columns:
        w = w.partitionBy(split_col)
    w.parquet(os.path.join(folder, "data"))
    for pname, pdf in (params or {}).items():
        pdf.coalesce(1).write.parquet(os.path.join(folder, "params", pname))
    newest = _manifests(spark, base)
    number = int(newest[-1].rpartition("/")[2].partition("-")[0]) + 1 if newest else 0
    text = json.dumps({"version": version, "params": sorted(params or {}), "spec": spec})
    spark.createDataFrame([(text,)], "manifest string").coalesce(1).write.parquet(
        os.path.join(base, "manifests", f"{number:012d}-{version}"))
    return folder


def _manifests(spark: SparkSession, base: str) -> list[str]:
    """Folders of the whole manifests, oldest first."""
    from veritab.sources.readers import list_folder, path_exists
    folder = os.path.join(base, "manifests")
    if not path_exists(spark, folder):
        return []
    # each has a number, then the version; _SUCCESS is the last file of a write
    return [p for p in sorted(list_folder(spark, folder), key=lambda p: p.rpartition("/")[2]) if path_exists(spark, p + "/_SUCCESS")]


def load_manifest(spark: SparkSession, name: str, root: str | None = None, back: int = 0) -> dict | None:
    """The manifest of the current version (``back`` versions before it), None
    if there is none."""
    own = _manifests(spark, _prepared_base(spark, name, root))
    return json.loads(spark.read.parquet(own[-1 - back]).first()["manifest"]) if len(own) > back else None


def _version_folder(spark: SparkSession, name: str, root: str | None, version: str | None) -> str:
    if version is None:
        manifest = load_manifest(spark, name, root)
        if manifest is None:
            raise FileNotFoundError(f"no prepared table {name!r}")
        version = manifest["version"]
    return os.path.join(_prepared_base(spark, name, root), "versions", version)


def load_spec(spark: SparkSession, name: str, root: str | None = None) -> dict | None:
    """The ``spec`` of a prepared table, None if there is no such table."""
    manifest = load_manifest(spark, name, root)
    return manifest["spec"] if manifest else None


def load_prepared(spark: SparkSession, name: str, root: str | None = None,
                  split: str | None = None, version: str | None = None) -> DataFrame:
    """Read a prepared table (the current version, or the one named);
    ``split='train'`` prunes to one partition folder."""
    df = spark.read.parquet(os.path.join(_version_folder(spark, name, root, version), "data"))
    return df.where(F.col("split") == split) if split else df


def load_params(spark: SparkSession, name: str, pname: str, root: str | None = None, version: str | None = None) -> DataFrame:
    return spark.read.parquet(os.path.join(_version_folder(spark, name, root, version), "params", pname))


def model_id(model_type: str, dataset: str, when: datetime | None = None) -> str:
    """``<type>_<dataset>_<yyyymmdd_hhmmss>_<random>``; the last part keeps the
    runs of one second apart."""
    when = when or datetime.now(timezone.utc)
    return f"{model_type}_{dataset}_{when.strftime('%Y%m%d_%H%M%S')}_{uuid.uuid4().hex[:8]}"


def log_run(spark: SparkSession, model_type: str, dataset: str, metrics: DataFrame,
            params: dict, framework: str = "spark-ml", model=None,
            root: str | None = None) -> str:
    """Append one run row (id, type, dataset, framework, params, metrics map,
    created_at) to the runs table and save the fitted model (S6).

    ``metrics`` is a (name, value) table; it is folded into a map column on the
    executors, not collected.
    """
    base = store_root(spark, root)
    mid = model_id(model_type, dataset)
    row = (metrics.agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("metrics"))
           .select(F.lit(mid).alias("model_id"), F.lit(model_type).alias("model_type"),
                   F.lit(dataset).alias("dataset"), F.lit(framework).alias("framework"),
                   F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params"),
                   "metrics", F.current_timestamp().alias("created_at")))
    if model is not None:  # first, so that a run that is listed has its model
        save_model(spark, model, os.path.join(base, "models", mid))
    row.write.mode("append").parquet(os.path.join(base, "runs"))
    return mid


def save_model(spark: SparkSession, model, path: str) -> None:
    """Save a model of any family: Spark ML models with their own writer, in
    ``ml``; the rest of it (weights, feature names, the random features'
    parameters, labels) as one JSON row beside it."""
    from veritab.operators import models as M
    text, ml = M.model_to_json(model)
    spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path + "/spec")
    if ml is not None:
        ml.write().overwrite().save(path + "/ml")


def load_model(spark: SparkSession, mid: str, root: str | None = None):
    """The model of a logged run."""
    from veritab.operators import models as M
    path = os.path.join(store_root(spark, root), "models", mid)
    return M.model_from_json(spark.read.parquet(path + "/spec").first()["model"], path + "/ml")


def load_runs(spark: SparkSession, root: str | None = None) -> DataFrame:
    return spark.read.parquet(os.path.join(store_root(spark, root), "runs"))
