"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of this library wants, on a laptop or on a cluster.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Wide prepared tables (dozens of aliased, null-filtered columns) make
    # Catalyst's constraint inference grow combinatorially; the filters it
    # would infer are not needed by these plans.
    "spark.sql.constraintPropagation.enabled": "false",
}

WIDE_PLAN_COLUMNS = 32


def guard_wide_plan(spark: SparkSession, n_columns: int) -> None:
    """Turn constraint propagation off for plans over many columns."""
    if n_columns > WIDE_PLAN_COLUMNS:
        spark.conf.set("spark.sql.constraintPropagation.enabled", "false")


def get_spark(master: str | None = None, app_name: str = "veritab",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master`` is only set when given: on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator of the cluster sets it to shared storage and it
    is used as is. Only a local session without it gets a scratch folder;
    elsewhere the driver's disk is not the executors', so that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="veritab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


#: Rows of a task in a fit over packed blocks (SVMs, networks): a Python worker
#: is given all blocks of a task at once.
FIT_ROWS = 250_000
#: Bytes that a task of a forest reads in each pass. Its sums for every node are
#: sent after each level, so fewer and larger tasks send less.
FOREST_TASK_BYTES = 160_000_000


def fit_rows(model_type: str, features: int, params: list[dict]) -> int:
    """Rows that a task gets in a fit with any of ``params``. A forest keeps a
    row as objects: about 100 bytes, and four for each feature and each tree."""
    if model_type != "random_forest":
        return FIT_ROWS
    trees = max((int(p.get("n_estimators", 100)) for p in params), default=100)
    return max(1, FOREST_TASK_BYTES // (104 + 4 * features + 4 * trees))


def spread_for_iterations(df, rows: int = 0, per_task: int = 1_000_000):
    """Input of an iterative fit (forests, SVMs, gradient models, search),
    spread over at least the cluster's default parallelism, and over more tasks
    where one would get more than ``per_task`` of its ``rows``.

    A scan of a few files can yield fewer partitions than cores, and every
    training pass would then run on those few tasks. With at least as many
    input files (the normal case at scale) the frame is returned unchanged, so
    no shuffle is added. Looking at the files runs no job.
    """
    target = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))
    return df if len(df.inputFiles()) >= target else df.repartition(target)


def spread_by_label(df, label: str, rows: int, per_task: int):
    """``df`` spread like above, each task with its own range of labels, in
    their order. Rows of like labels fall into the same leaves: in a pass of a
    deep regression tree a task's sums of few leaves stay in a core's cache, not
    those of all. Rows of equal labels are parted by their place in the input."""
    from pyspark.sql import functions as F

    from veritab.functions.exprs import qcol
    target = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))
    place = "__place"
    while place in df.columns:
        place = "_" + place
    return (df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(target, qcol(label), place)
            .sortWithinPartitions(qcol(label)).drop(place))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``veritab`` importable in the Python workers (once per application).

    Python tasks (``mapInPandas``, pandas UDFs) unpickle references to
    functions of this package. On a cluster the package is shipped at submit
    time (``--py-files`` or the image). For a local or driver-launched
    session whose checkpoint folder is on a file system this process can
    write, the package is zipped there and added with ``addPyFile``; with a
    remote checkpoint folder nothing is done.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    base = checkpoint_dir(spark)
    if "://" in base and not base.startswith("file:"):
        _SHIPPED.add(sc.applicationId)
        return
    base = base[len("file:"):] if base.startswith("file:") else base
    pkg = os.path.dirname(os.path.abspath(__file__))
    out_dir = os.path.join(base, "pyfiles", sc.applicationId)
    os.makedirs(out_dir, exist_ok=True)
    zpath = os.path.join(out_dir, "veritab.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
