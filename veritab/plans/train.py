"""M9: load-or-prepare -> fit -> evaluate -> log the run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import qcol
from veritab.operators import evaluate as E
from veritab.operators.models import train
from veritab.operators.schema import infer_task
from veritab.plans.prepare import Prepared, prepare
from veritab.sources.storage import load_manifest, load_params, load_prepared, log_run, save_prepared


@dataclass
class TrainResult:
    model_id: str | None
    model: object
    task: str
    metrics: DataFrame
    predictions: DataFrame
    prepared: Prepared


def train_dataset(df: DataFrame, model_type: str, params: dict | None = None,
                  target: str | None = None, ratio: float = 0.8, key: str | None = None,
                  steps=("drop_nulls", "normalize", "one_hot_encode"), dataset_name: str = "dataset",
                  log: bool = True, max_classes: int = 10, stored_as: str | None = None) -> TrainResult:
    """Prepare (P7), fit on the train split, predict the test split, compute
    the metrics (E1-E4) and append the run to the runs table (S6).

    With ``stored_as`` the prepared table of that name is loaded if there is
    one, and else prepared from ``df`` and stored under it (S5)."""
    prep = load_or_prepare(df, stored_as, steps, ratio, target, key)
    data = prep.data
    task = infer_task(data, prep.target, max_classes)
    train_df = data.where(F.col("split") == "train")
    test_df = data.where(F.col("split") == "test")
    model = train(train_df, prep.features, prep.target, model_type, task, params)
    out = model.transform(test_df)
    pred = out.select(qcol(prep.target).alias("label"), "prediction",
                      *(["probability"] if "probability" in out.columns else []))
    metrics = (E.classification_metrics(pred) if task == "classification"
               else E.regression_metrics(pred))
    mid = None
    if log:
        mid = log_run(df.sparkSession, model_type, dataset_name, metrics, params or {}, model=model)
    return TrainResult(mid, model, task, metrics, pred, prep)


def load_or_prepare(df: DataFrame, stored_as: str | None, steps, ratio: float, target: str | None,
                    key: str | None) -> Prepared:
    spark = df.sparkSession
    manifest = load_manifest(spark, stored_as) if stored_as else None
    if manifest is None:
        prep = prepare(df, steps, ratio, target, key)
        if not stored_as:
            return prep
        many = isinstance(prep.task_labels, DataFrame)
        spec = {f: getattr(prep, f) for f in ("target", "features", "numeric", "categorical", "categories")}
        spec["task_labels"] = None if many else prep.task_labels
        tables = {"stats": prep.stats, "scaler": prep.scaler, "labels": prep.task_labels if many else None}
        save_prepared(prep.data, stored_as, {k: t for k, t in tables.items() if t is not None}, spec=spec)
        manifest = load_manifest(spark, stored_as)
    # one manifest for all parts, so that they are of one version
    version, tables = manifest["version"], {k: load_params(spark, stored_as, k, version=manifest["version"]) for k in manifest["params"]}
    own = dict(manifest["spec"])
    if "labels" in tables:
        own["task_labels"] = tables["labels"]
    return Prepared(load_prepared(spark, stored_as, version=version), tables["stats"], scaler=tables.get("scaler"), **own)
