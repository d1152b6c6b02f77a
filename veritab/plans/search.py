"""Grid and random search with k-fold cross-validation.

Folds are a column (T2). Models of all combinations and folds are trained
together: one pass over the packed rows serves every support vector machine,
network or classification forest that has not ended, and one more pass scores
them all. Other models (regression forests, very deep ones, those of a single
combination, sigmoid networks) are ordinary Spark ML fits on one persisted copy of the data, up to
``parallelism`` at a time. Only the grid x folds score table comes back to the
driver.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions.exprs import qcol
from veritab.operators import evaluate as E
from veritab.operators import forests, models
from veritab.operators.gradient import GradientModel, Table, _unpacked, fit_nets, pack, wide_columns
from veritab.operators.tuning import (assign_folds, boundary_folds, fold_places, grid_combinations, grid_dict, rank_results,
                                      random_search as sample_grid)

# Objectives the tuning UI offers.
OBJECTIVES = ("accuracy", "f1", "auc", "recall", "precision", "log_loss", "rmse", "neg_mean_squared_error")


@dataclass
class SearchResult:
    results: DataFrame        # combo, params, mean_test_score, std_test_score, rank_test_score
    best_params: dict
    best_score: float
    scores: DataFrame         # combo, fold, score


def score_predictions(pred: DataFrame, label: str, objective: str, labels: list | None = None) -> float | None:
    """Higher is better for every objective (errors are returned negated).

    ``labels`` is the order of the classes in ``probability`` (``models.label_order``).
    ``auc`` is the area for the second of two classes, and the mean over the
    pairs of several; it is None where only one class has rows."""
    if objective == "accuracy":
        return E.accuracy(pred, label).first()[0]
    if objective in ("f1", "precision", "recall"):
        return E.macro_precision_recall_f1(pred, label).first()[objective]
    if objective in ("rmse", "neg_mean_squared_error"):
        m = {r["name"]: r["value"] for r in E.regression_metrics(pred, label).collect()}
        return -(m[E.RMSE] if objective == "rmse" else m[E.MSE])
    if objective == "auc":
        if "probability" not in pred.columns:
            raise ValueError("auc needs a classifier with probabilities")
        return E.multiclass_auc(E.class_pair_auc(pred, label, "probability", labels)).first()[0]
    if objective == "log_loss":
        loss = E.log_loss(pred, label, "probability", labels).first()[0]
        return None if loss is None else -loss
    raise ValueError(f"unknown objective {objective!r}")


def _together(model_type: str, task: str, params: dict, objective: str) -> bool:
    """Whether the engine that trains many models at once has this one."""
    if objective not in COUNTED:
        return False
    if model_type == "svm":
        return True
    return model_type in ("neural_network", "mlp") and not (
        task == "classification" and params.get("activation", "relu") in ("sigmoid", "logistic"))


#: Objectives that follow from counts of (label, prediction) or sums of errors.
COUNTED = ("accuracy", "f1", "precision", "recall", "rmse", "neg_mean_squared_error")


def fit_together(data: DataFrame, features: list[str], label: str, model_type: str, task: str, combos: list[dict], k: int,
                 objective: str) -> list[tuple[int, int, float | None]]:
    """(combo, fold, score) of all combinations, trained and scored in shared passes."""
    labels = models.class_labels(data, label) if task == "classification" else []
    if labels and labels != [float(i) for i in range(len(labels))]:
        data = models.index_labels(data, label, labels)
    jobs = [(ci, f) for ci in range(len(combos)) for f in range(k)]
    table = pack(data, features, label, fold="fold", folds=k)
    try:
        nets = []
        for ci, f in jobs:
            own = models.family_params(model_type, combos[ci])
            if model_type == "svm":
                own = {c: v for c, v in own.items() if c != "probability"}
                nets.append(models.svm_net(data.where(F.col("fold") != f), table, task, classes=max(len(labels), 2), without_fold=f, **own))
            else:
                own.pop("lr", None)
                nets.append(models.mlp_net(task, classes=len(labels), without_fold=f, **own))
        scores = score_together(table, fit_nets(table, nets), [f for _, f in jobs], task, objective)
    finally:
        table.close()
    return [(ci, f, scores.get(j)) for j, (ci, f) in enumerate(jobs)]


def score_together(table: Table, fitted: list[GradientModel], folds: list[int], task: str, objective: str) -> dict[int, float]:
    """Score of every model on the rows of its fold, in one pass."""
    sent = table.blocks.sparkSession.sparkContext.broadcast((fitted, folds))
    width, has_wide = len(table.dense), bool(table.wide)

    def part(batches):
        counts: dict[tuple, list[float]] = {}
        own, at = sent.value
        for block in _unpacked(batches, width, has_wide):
            test = {f: block.rows(block.fold == f) for f in set(at)}
            for j, (model, f) in enumerate(zip(own, at)):
                rows = test[f]
                if not len(rows.y):
                    continue
                out = model.margins(rows.x, rows.wide)
                if task == "classification":
                    p = (out[:, 0] > 0).astype(float) if out.shape[1] == 1 else out.argmax(axis=1).astype(float)
                    pairs, n = np.unique(np.column_stack([rows.y, p]), axis=0, return_counts=True)
                    for (y, q), c in zip(pairs.tolist(), n.tolist()):
                        counts.setdefault((j, y, q), [0.0, 0.0])[0] += c
                else:
                    r = out[:, 0] * model.y_std + model.y_mean - rows.y
                    total = counts.setdefault((j, 0.0, 0.0), [0.0, 0.0])
                    total[0] += len(r)
                    total[1] += float(r @ r)
        if counts:
            keys, sums = zip(*counts.items())
            columns = [*zip(*keys), *zip(*sums)]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]],
                                             names=["job", "label", "prediction", "n", "squares"])

    parts = (table.blocks.mapInArrow(part, "job int, label double, prediction double, n double, squares double")
             .groupBy("job", "label", "prediction").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")))
    found = _counted_scores(parts, task, objective)
    sent.unpersist()
    return found


def _counted_scores(parts: DataFrame, task: str, objective: str) -> dict[int, float]:
    """Score of every job from its counts of (label, prediction) or its sums of squared errors."""
    if task != "classification":
        mse = F.col("squares") / F.col("n")
        out = parts.select("job", (-(F.sqrt(mse) if objective == "rmse" else mse)).alias("score"))
    elif objective == "accuracy":
        hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0.0)
        out = parts.groupBy("job").agg((F.sum(hit) / F.sum("n")).alias("score"))
    else:
        out = E.macro_of_counts(parts, ["job"]).select("job", F.col(objective).alias("score"))
    return {r["job"]: r["score"] for r in out.collect()}


# Forests ---------------------------------------------------------------------

#: Scores that a task holds before it counts equal ones.
HELD_SCORES = 1 << 20


def _forest_together(model_type: str, task: str, params: dict, features: int, classes: int) -> bool:
    """Whether a forest is one of those that are grown level by level together."""
    return (model_type == "random_forest" and task == "classification" and classes > 0
            and set(params) <= {"n_estimators", "max_depth", "min_samples_split", "seed"}
            and forests.fits(models._depth(params.get("max_depth")), classes, features))


def fit_forests_together(data: DataFrame, features: list[str], label: str, combos: list[dict], k: int, objective: str,
                         labels: list[float], rows: int) -> list[tuple[int, int, float | None]]:
    """(combo, fold, score) of forests, grown and scored in shared passes."""
    if labels != [float(i) for i in range(len(labels))]:
        data = models.index_labels(data, label, labels)
    jobs = [(ci, f) for ci in range(len(combos)) for f in range(k)]
    table = forests.pack(data, features, label, k, len(labels), rows)
    try:
        plans = []
        for ci, f in jobs:
            own = combos[ci]
            plans.append(forests.Forest(int(own.get("n_estimators", 100)), models._depth(own.get("max_depth")),
                                        max(1, int(own.get("min_samples_split", 2)) // 2), int(own.get("seed", 42)), f))
        trees, fitted = forests.fit_forests(table, plans)
        scores = score_forests(table, trees, fitted, objective)
    finally:
        table.close()
    return [(ci, f, scores.get(j)) for j, (ci, f) in enumerate(jobs)]


def score_forests(table: forests.Table, trees: list[tuple], fitted: list[forests.ForestModel], objective: str) -> dict[int, float]:
    """Score of every forest on the rows of its fold, in one pass."""
    sent, read = table.blocks.sparkSession.sparkContext.broadcast((trees, fitted)), forests.Table(None, table.features, table.classes,
                                                                                                  table.folds, []).read
    # classes with rows outside a fold, which a forest without it knows
    known = [(table.sizes.sum(axis=0) - table.sizes[m.view] > 0) for m in fitted]

    def batch(names, rows):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=names)

    def predicted(batches):
        own, counts = sent.value, {}
        for block in read(batches):
            for j, y, p in forests.probabilities(block, *own):
                n = np.bincount(y.astype(np.int64) * p.shape[1] + p.argmax(axis=1), minlength=p.shape[1] ** 2)
                counts[j] = counts.get(j, 0) + n
        rows = []
        for j, n in counts.items():
            at, classes = np.flatnonzero(n), math.isqrt(len(n))
            rows.append((np.full(len(at), j, np.int32), at // classes / 1.0, at % classes / 1.0, n[at] / 1.0, np.zeros(len(at))))
        if rows:
            yield batch(["job", "label", "prediction", "n", "squares"], rows)

    def losses(batches):
        own, sums = sent.value, {}
        for block in read(batches):
            for j, y, p in forests.probabilities(block, *own):
                loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).sum()
                n, s = sums.get(j, (0, 0.0))
                sums[j] = n + len(y), s + float(loss)
        if sums:
            yield batch(["job", "n", "loss"], [(np.array([j], np.int32), np.array([n / 1.0]), np.array([s])) for j, (n, s) in sums.items()])

    def shares(batches):
        names, own, held, size = ["job", "k", "s", "y", "n"], sent.value, {}, 0

        def counted():
            rows = []
            for j, parts in held.items():
                y, p = (np.concatenate(c) for c in zip(*parts))
                for c in np.flatnonzero(known[j]):
                    s, at = np.unique(p[:, c], return_inverse=True)
                    n = np.bincount(at.ravel() * p.shape[1] + y, minlength=len(s) * p.shape[1])
                    full = np.flatnonzero(n)
                    label = full % p.shape[1]
                    full, label = full[known[j][label]], label[known[j][label]]
                    rows.append((np.full(len(full), j, np.int32), np.full(len(full), c, np.int32), s[full // p.shape[1]],
                                 label.astype(np.int32), n[full]))
            return batch(names, rows)

        for block in read(batches):
            for j, y, p in forests.probabilities(block, *own):
                held.setdefault(j, []).append((y.astype(np.int64), p))
                size += p.size
            if size >= HELD_SCORES:
                yield counted()
                held, size = {}, 0
        if held:
            yield counted()

    if objective == "auc":
        counts = table.blocks.mapInArrow(shares, "job int, k int, s double, y int, n bigint").groupBy("job", "k", "s", "y").agg(F.sum("n").alias("n"))
        rows = E.pair_auc_of_counts(counts, ["job"]).groupBy("job").agg(F.avg("auc").alias("score")).collect()
    elif objective == "log_loss":
        sums = table.blocks.mapInArrow(losses, "job int, n double, loss double").groupBy("job")
        rows = sums.agg((-F.sum("loss") / F.sum("n")).alias("score")).collect()
    else:
        parts = (table.blocks.mapInArrow(predicted, "job int, label double, prediction double, n double, squares double")
                 .groupBy("job", "label", "prediction").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")))
        return _counted_scores(parts, "classification", objective)
    sent.unpersist()
    return {r["job"]: r["score"] for r in rows}


def cross_validate(df: DataFrame, features: list[str], label: str, model_type: str, task: str,
                   combos: list[dict], k: int = 3, key: str | None = None, seed: int = 42,
                   objective: str | None = None, parallelism: int = 4) -> SearchResult:
    objective = objective or ("accuracy" if task == "classification" else "neg_mean_squared_error")
    stratify = label if task == "classification" else None
    base = df.select(*map(qcol, dict.fromkeys([*features, label, *([key] if key else [])])))
    if stratify is not None:
        # The boundaries of stratified folds take five reads of the input;
        # keep it for those only.
        base = fold_places(base, key, seed, stratify).persist()
    folded = assign_folds(base, k, key, seed) if stratify is None else boundary_folds(base, k, key, seed, stratify=stratify, placed=True)
    size = base.count()
    rows, left = [], range(len(combos))
    if model_type == "random_forest" and stratify is not None and not wide_columns(base, features):
        labels = models.class_labels(base, label)
        own = [i for i in left if _forest_together(model_type, task, combos[i], len(features), len(labels))]
        if len(own) > 1:  # the folds of one combination are fits as M1 makes them
            found = fit_forests_together(folded, features, label, [combos[i] for i in own], k, objective, labels, size)
            rows = [(own[i], f, s) for i, f, s in found]
            left = [i for i in left if i not in own]
    if left:
        rows += _fits(folded, base, features, label, model_type, task, {i: combos[i] for i in left}, k, objective, size, parallelism)
    if stratify is not None:
        base.unpersist()
    rows = sorted((ci, f, None if s is None else float(s)) for ci, f, s in rows)
    spark = df.sparkSession
    scores = spark.createDataFrame(rows, "combo int, fold int, score double")
    params = spark.createDataFrame([(i, {k2: json.dumps(v) for k2, v in c.items()})
                                    for i, c in enumerate(combos)],
                                   "combo int, params map<string,string>")
    ranked = rank_results(scores).join(F.broadcast(params), "combo")
    means = {}
    for ci, _, s in rows:
        if s is not None:  # a fold with one class has no area
            means.setdefault(ci, []).append(s)
    mean = {i: sum(v) / len(v) for i, v in means.items()}
    best_ci = max(range(len(combos)), key=lambda i: (mean.get(i, -math.inf), -i))
    best = mean.get(best_ci, math.nan)
    return SearchResult(ranked, combos[best_ci], best, scores)


def _fits(folded: DataFrame, base: DataFrame, features: list[str], label: str, model_type: str, task: str, combos: dict[int, dict],
          k: int, objective: str, size: int, parallelism: int) -> list[tuple[int, int, float | None]]:
    """(combo, fold, score) of support vector machines and networks in shared
    passes, of others one by one. ``base``, below ``folded``, is let go once read."""
    from veritab.session import fit_rows, spread_for_iterations
    together = [i for i, c in combos.items() if _together(model_type, task, c, objective)]
    per_task = fit_rows(model_type, len(features), list(combos.values()))
    data = spread_for_iterations(folded, size, per_task).persist()
    # a fit with rows for every core has no use for others beside it, which
    # would all keep their copies of the rows
    parallelism = parallelism if size < per_task * folded.sparkSession.sparkContext.defaultParallelism else 1
    try:
        # Materialise once before the concurrent fits, so the threads do not
        # each recompute the uncached lineage.
        data.count()
        base.unpersist()
        rows = []
        if together:
            found = fit_together(data, features, label, model_type, task, [combos[i] for i in together], k, objective)
            rows = [(together[i], f, s) for i, f, s in found]

        def run(job):
            ci, f = job
            tr = data.where(F.col("fold") != f)
            te = data.where(F.col("fold") == f)
            model = models.train(tr, features, label, model_type, task, combos[ci], spread=False)
            return ci, f, score_predictions(model.transform(te), label, objective, models.label_order(model))
        jobs = [(ci, f) for ci in combos for f in range(k) if ci not in together]
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            rows += list(ex.map(run, jobs))
    finally:
        data.unpersist()
    return rows


def grid_search(df: DataFrame, features: list[str], label: str, model_type: str, task: str,
                grid: dict | None = None, k: int = 3, key: str | None = None, seed: int = 42,
                parallelism: int = 4) -> SearchResult:
    """Exhaustive search (T3); accuracy or negative MSE."""
    combos = grid_combinations(grid or grid_dict(model_type))
    return cross_validate(df, features, label, model_type, task, combos, k, key, seed,
                          None, parallelism)


def cross_val_score(search: SearchResult) -> float:
    """T5: the best combination's mean score over the same folds (no re-fit)."""
    return search.best_score


def random_search(df: DataFrame, features: list[str], label: str, model_type: str, task: str,
                  n: int, grid: dict | None = None, k: int = 3, key: str | None = None,
                  seed: int = 42, objective: str | None = None, parallelism: int = 4) -> SearchResult:
    """``n`` combinations sampled reproducibly from the grid, scored by ``objective``."""
    from veritab.operators.tuning import param_grid
    spark = df.sparkSession
    all_combos = grid_combinations(grid or grid_dict(model_type))
    table = spark.createDataFrame([(i,) for i in range(len(all_combos))], "combo int")
    picked = [r["combo"] for r in sample_grid(table, n, seed).collect()]
    combos = [all_combos[i] for i in sorted(picked)]
    return cross_validate(df, features, label, model_type, task, combos, k, key, seed,
                          objective, parallelism)
