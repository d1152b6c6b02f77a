"""Connected components of an edge table by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (u, v); the root is the
    smallest node of its component.

    Each step links every node's larger neighbours, then its smaller ones, to
    the smallest node in reach (Kiveris et al., "Connected Components in
    MapReduce and Beyond", 2014). Minima are aggregates and are joined back,
    so no neighbourhood is gathered in one place; steps are written out.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                      .distinct(), "components")
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        then = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                           "components")
        # It is done when every edge leads from a node to a root: each node
        # has one edge and no root is a node with an edge of its own.
        open_ends = then.select(F.col("v").alias("u")).join(then, "u", "left_semi").limit(1).count()
        if not open_ends and then.groupBy("u").count().where("count > 1").limit(1).count() == 0:
            return then.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                then.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now = then
