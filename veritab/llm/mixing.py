"""Operator 3: mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, col, materialize, row_struct

WEIGHTS = (3, 1, 2)
BUDGET_RATIO = 1.5
MAX_EPOCHS = 2
#: Hex digits of the shuffle key that form a bucket: 16 ** 3 buckets a source.
BUCKET_DIGITS = 3
#: Equal slices of virtual time that are sorted independently.
TIME_SLICES = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, budget_ratio: float = BUDGET_RATIO,
                   max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source (``skey``, ``source``, ``source_size``) plus its
    ``rank``, ``weight``, ``target`` and the common ``level`` and ``budget``.

    Sources rank by code point, null last, and get the weights in turn. With
    a level L of virtual time each source takes min(weight * L, max_epochs *
    size); L is chosen so that the takes add up to the budget. In the order in
    which sources run dry, the level that would result if exactly the sources
    before one were dry rises and then falls, and its maximum is L.
    """
    everything = W.partitionBy()
    drained = W.orderBy("dry_at", "rank")
    before = drained.rowsBetween(W.unboundedPreceding, -1)
    ranked = (sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
              .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]),
                                                 (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * max_epochs)
              .withColumn("dry_at", F.col("cap") / F.col("weight"))
              .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_ratio))))
    return (ranked
            .withColumn("used", F.coalesce(F.sum("cap").over(before), F.lit(0)))
            .withColumn("left_weight", F.sum("weight").over(everything)
                        - F.coalesce(F.sum("weight").over(before), F.lit(0)))
            .withColumn("level", F.max((F.col("budget") - F.col("used")) / F.col("left_weight")).over(everything))
            .withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
            .select("skey", "source", "source_size", "rank", "weight", "target", "level", "budget"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_ratio: float = BUDGET_RATIO,
                max_epochs: int = MAX_EPOCHS, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", carry: bool = False) -> DataFrame:
    """Which documents a mix takes, and how often.

    Every source is shuffled by the MD5 of the id. The e-th copy of a document
    (e < ``max_epochs``) finishes at virtual time (e * source size + words of
    the source up to and with it) / weight; all copies in order of that time
    (then source rank, epoch, key, id, size) are taken until the next one
    would pass the budget (``budget_ratio`` times all words). Returns
    ``doc_id, source, size, source_size, target, copies, taken`` per row of
    ``docs``; with ``carry`` also ``row``, the whole input row as a struct.

    Running sums are split: (source, bucket) totals give each bucket of a
    source its start, so a source with a third of all rows spreads over 4,096
    groups; the cut is found the same way over slices of virtual time. Only
    those totals (sources x 4,096 rows) meet in one place per source.

    A null or empty text has size 0, a null source is a source of its own
    (last in rank), null ids share one key; rows with equal id and size are
    interchangeable. An empty table or one without words takes nothing but
    empty documents. Columns of ``docs`` with names used here do no harm.
    """
    base = docs.select(
        col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *([row_struct(docs).alias("row")] if carry else []))
    base = (base.withColumn("skey", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
            .withColumn("key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
            .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    totals = materialize(base.groupBy("skey", "source", "bucket").agg(F.sum("size").alias("bucket_size")), "mix-totals")
    sources = source_targets(totals.groupBy("skey", "source").agg(F.sum("bucket_size").alias("source_size")),
                             weights, budget_ratio, max_epochs)
    starts = (totals.withColumn("start", F.coalesce(
                F.sum("bucket_size").over(W.partitionBy("skey").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0)))
              .join(sources.drop("source"), "skey")
              .select("skey", "bucket", "start", "source_size", "rank", "weight", "target", "level", "budget"))
    starts = materialize(starts, "mix-starts")

    running = W.partitionBy("skey", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)

    def placed(frame: DataFrame) -> DataFrame:
        return frame.join(starts, ["skey", "bucket"]).withColumn("done", F.col("start") + F.sum("size").over(running))

    def finish(epoch) -> F.Column:
        return (F.col("source_size") * epoch + F.col("done")) / F.col("weight")

    copies = (placed(base.drop("row")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("finish", finish(F.col("epoch")))
              .withColumn("slice", F.when(F.col("level") > 0, F.least(
                  F.floor(F.col("finish") / F.col("level") * TIME_SLICES), F.lit(4 * TIME_SLICES))).otherwise(F.lit(0)))
              .select("slice", "finish", "rank", "epoch", "key", "doc_id", "size", "budget"))
    copies = materialize(copies, "mix-copies")
    slices = (copies.groupBy("slice").agg(F.sum("size").alias("slice_size"))
              .withColumn("slice_start", F.coalesce(
                  F.sum("slice_size").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .select("slice", "slice_start"))
    order = ["finish", "rank", "epoch", "key", "doc_id", "size"]
    within = W.partitionBy("slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cut = (copies.join(slices, "slice").withColumn("spent", F.col("slice_start") + F.sum("size").over(within))
           .where(F.col("spent") > F.col("budget")).agg(F.min(F.struct(*order)).alias("cut")).first()["cut"])

    out = placed(base)
    if cut is None:
        n = F.lit(max_epochs)
    else:
        bound = F.struct(*[F.lit(cut[c]).cast(copies.schema[c].dataType).alias(c) for c in order])
        n = sum((F.when(F.struct(finish(F.lit(e)).alias("finish"), F.col("rank"), F.lit(e).alias("epoch"),
                                 F.col("key"), F.col("doc_id"), F.col("size")) < bound, 1).otherwise(0)
                 for e in range(max_epochs)), F.lit(0))
    return (out.withColumn("copies", n)
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if carry else [])))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken,
    with the columns of ``docs``."""
    mixed = mix_sources(docs, carry=True, **options).where(F.col("copies") > 0)
    return (mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
