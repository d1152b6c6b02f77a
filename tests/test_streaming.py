import os
import tempfile

from pyspark.sql import functions as F

from veritab.sources.tables import load_table
from veritab.streaming.monitor import drift_monitor

from conftest import SF_SMALL


def test_drift_monitor_batches(spark):
    ev = load_table(spark, SF_SMALL, "events")
    src = tempfile.mkdtemp(prefix="veritab-stream-src-")
    # two files -> (at most) two micro-batches with one file per trigger
    ev.where(F.col("ts") < "2024-01-16").write.mode("overwrite").parquet(os.path.join(src, "a"))
    ev.where(F.col("ts") >= "2024-01-16").write.mode("overwrite").parquet(os.path.join(src, "b"))
    stream = (spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", True).parquet(src))
    out = tempfile.mkdtemp(prefix="veritab-stream-out-")
    ref = ev.where(F.col("ts") < "2024-01-16")
    q = drift_monitor(ref, stream, out, name="t_monitor", columns=["user_id", "event_type", "value"])
    q.awaitTermination(300)
    drift = spark.read.parquet(os.path.join(out, "drift"))
    quality = spark.read.parquet(os.path.join(out, "quality"))
    assert drift.select("batch_id").distinct().count() >= 1
    assert drift.where(F.col("column_name") == "event_type").count() >= 1
    assert quality.agg(F.sum("row_count")).first()[0] == ev.count()
