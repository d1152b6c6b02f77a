"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.session import checkpoint_dir, ship_package

#: Words are maximal runs of characters that are none of the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rows up to which the small side of a join is sent to every executor; one
#: row is an id of 8 bytes, so the broadcast stays under a few tens of MB.
BROADCAST_ROWS = 1_000_000


def col(name: str) -> Column:
    """A column by its exact name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_struct(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that no name can clash."""
    return F.struct(*[col(c) for c in df.columns])


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    The lineage is cut there: a lost executor costs a re-read, not a
    recomputation, and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/veritab-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows (they
    are counted); beyond that the join shuffles as usual."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def byte_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes, at least one row each."""
    if not len(sizes):
        return iter(())
    groups = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(sizes)]])
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def release_memory() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no glibc
        pass


def trimmed(batches: Iterator) -> Iterator:
    """``batches`` of a task; behind the last one, memory that the task has
    freed goes back to the system. Python workers live on after a task, and what
    they hold would be missing in the stages behind it."""
    try:
        yield from batches
    finally:
        gc.collect()
        release_memory()


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the Python workers."""
    ship_package(spark)
