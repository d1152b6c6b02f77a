"""Continuous drift and quality checks on a stream of micro-batches.

The reference compares a reference table with a current table once. On a
stream, each micro-batch is the current table: ``foreachBatch`` runs the same
batch operators (D6 drift report, Q9 quality counts) against the fixed
reference table and appends the per-batch results, tagged with the batch id,
to parquet tables. Progress and exactly-once output come from the streaming
checkpoint, which lives under the cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.drift import drift_report, reduce_reference
from veritab.operators.profile import quality_counts
from veritab.session import checkpoint_dir


def drift_monitor(reference: DataFrame, stream: DataFrame, out_dir: str, name: str = "drift_monitor",
                  columns: list[str] | None = None, threshold: float = 0.1,
                  trigger: dict | None = None):
    """Start a streaming query that writes, per micro-batch, the drift report
    against ``reference`` to ``<out_dir>/drift`` and the quality counts to
    ``<out_dir>/quality``. Returns the ``StreamingQuery``.

    ``reference`` is read once, when the query starts: its moments and category
    counts serve all batches. A batch is kept while its two reports are made.
    """
    spark = stream.sparkSession
    ckpt = os.path.join(checkpoint_dir(spark), "streams", name)
    reduced = reduce_reference(reference, stream, columns)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        # Written with an idempotent layout: a re-run batch overwrites its own
        # partition, so a retried batch never duplicates rows.
        batch = batch.persist()
        try:
            rep = drift_report(reference, batch, columns, threshold, reduced).withColumn("batch_id", F.lit(batch_id))
            q = quality_counts(batch).withColumn("batch_id", F.lit(batch_id))
            for df, sub in ((rep, "drift"), (q, "quality")):
                (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("batch_id").parquet(os.path.join(out_dir, sub)))
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.queryName(name).start()
