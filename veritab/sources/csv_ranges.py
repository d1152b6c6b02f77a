"""CSV with line breaks in quoted fields, read by many tasks (part of S1).

Spark reads such a file in one task, as a line break may or may not end a
record. Here the file's byte ranges are scanned as lines, and what a range does
to the state "inside a quoted field" is found for both states it may start
with: a function of two states. Functions compose, so a running composition
over the ranges of a file (a few numbers a range) gives every range its true
start. Records that cross ranges are put together from the lines at the ranges'
ends; all others are found inside their range, where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.session import ship_package

#: Ranges up to which their states are sent to every executor (some 60 bytes
#: each); beyond, lines and states meet in a shuffle join.
BROADCAST_RANGES = 1_000_000
RANGE_TYPE = "f long, b long, first long, end0 int, end1 int, head0 long, head1 long, tail1 long"


def ends_open(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open at the end of ``line``, if one is open at
    its start (``inside``) or a record starts there. Quotes are doubled in
    quoted fields; a quote that starts no field is an ordinary character, and
    what follows a closing quote belongs to the field up to the separator."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            at = line.find(sep, at + 1)
            if at < 0:
                return False
            at, inside = at + 1, False
        elif line.startswith('"', at):
            at, inside = at + 1, True
        else:
            at = line.find(sep + '"', at)
            if at < 0:
                return False
            at, inside = at + 2, True


class RangeState:
    """A range's walk from both start states (0: a record starts, 1: inside a
    quoted field): the state now, the line where the open record starts, and
    the line behind the first record end, from inside."""

    def __init__(self, f: int, b: int, first: int):
        self.f, self.b, self.first = f, b, first
        self.now, self.head, self.tail = [0, 1], [None, None], None

    def step(self, line: str, number: int, sep: str) -> None:
        was = self.now
        first = int(ends_open(line, was[0] == 1, sep))
        # once both walks are in one state, they stay together
        self.now = [first, first if was[0] == was[1] else int(ends_open(line, was[1] == 1, sep))]
        if self.now == was:
            return
        for start in (0, 1):
            if was[start] and not self.now[start]:
                self.head[start] = None
                if start and self.tail is None:
                    self.tail = number + 1
            elif not was[start] and self.now[start]:
                self.head[start] = number

    def row(self) -> tuple:
        return self.f, self.b, self.first, *self.now, *self.head, self.tail


def _states(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    names = ["f", "b", "first", "end0", "end1", "head0", "head1", "tail1"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3]
    now, done = None, []
    for batch in batches:
        f, b, number = (batch.column(c).to_numpy() for c in ("f", "b", "number"))
        quoted = batch.column("quoted")
        new = np.flatnonzero(np.concatenate([[True], (f[1:] != f[:-1]) | (b[1:] != b[:-1])])) if len(f) else []
        for start, end in zip(new, [*new[1:], len(f)]):
            if now is None or (now.f, now.b) != (f[start], b[start]):
                if now is not None:
                    done.append(now.row())
                now = RangeState(int(f[start]), int(b[start]), int(number[start]))
            for line, n in zip(quoted.slice(start, end - start).to_pylist(), number[start:end].tolist()):
                if line is not None:
                    now.step(line, n, sep)
    if now is not None:
        done.append(now.row())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)


def _records(batches: Iterator[pa.RecordBatch], sep: str) -> Iterator[pa.RecordBatch]:
    """Whole records of lines that start and end with one; the header, the
    first record of a file, is left out."""
    pending, at, header = [], None, False
    for batch in batches:
        out = []
        for f, b, line in zip(*(batch.column(c).to_pylist() for c in ("f", "b", "value"))):
            if (f, b) != at:
                at, header = (f, b), b == 0
            pending.append(line)
            if '"' in line and ends_open(line, len(pending) > 1, sep) or len(pending) > 1 and '"' not in line:
                continue
            record = "\n".join(pending)
            pending = []
            if header and record.rstrip("\r"):
                header = False
            else:
                out.append(record)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["record"])


def range_states(lines: DataFrame, sep: str) -> DataFrame:
    """Per byte range ``f, b, start`` (its true start state), ``tail_until``
    (lines before it belong to an earlier record), ``head_from`` (lines from
    there on to a record that goes on in the next range) and ``group``, the
    number of records that cross into later ranges before this one."""
    states = lines.mapInArrow(lambda it: _states(it, sep), RANGE_TYPE)
    file = Window.partitionBy("f").orderBy("b")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    # a range keeps the state, swaps it, or sets it whatever it was
    is_set = F.col("end0") == F.col("end1")
    states = states.withColumn("swap", (F.col("end0") > F.col("end1")).cast("int"))
    states = states.withColumn("swaps", F.sum("swap").over(file))
    last_set = F.last(F.when(is_set, F.struct("end0", "swaps")), ignorenulls=True).over(before)
    states = states.withColumn("set", last_set).withColumn(
        "start", F.pmod(F.coalesce(F.col("set.end0"), F.lit(0)) + F.coalesce(F.sum("swap").over(before), F.lit(0))
                        - F.coalesce(F.col("set.swaps"), F.lit(0)), F.lit(2)))
    inside = F.col("start") == 1
    far = F.lit(2 ** 63 - 1)
    states = (states.withColumn("tail_until", F.when(inside, F.coalesce("tail1", far)).otherwise(F.col("first")))
              .withColumn("head_from", F.coalesce(F.when(inside, F.col("head1")).otherwise(F.col("head0")), far)))
    return states.select("f", "b", "first", "start", "tail_until", "head_from", F.coalesce(
        F.sum((F.col("head_from") < far).cast("long")).over(before), F.lit(0)).alias("group"))


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """``f, b, number, value``: a file's lines (without their newline), the
    file's hash, the start of their byte range, and a number that rises along
    the file and is the same in every scan."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("number"), "value")


def crosses_lines(lines: DataFrame, sep: str) -> bool:
    """Whether any record has more than one line, or a lone carriage return."""
    lone = F.instr("value", "\r")
    some = lines.where(F.col("value").contains('"') | ((lone > 0) & (lone < F.length("value")))).select("value")

    def found(batches):
        hits = any(ends_open(v, False, sep) or "\r" in v[:-1] for batch in batches for v in batch.column("value").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([hits])], names=["hit"])

    return some.mapInArrow(found, "hit boolean").where("hit").limit(1).count() > 0


def csv_records(lines: DataFrame, sep: str = ",", broadcast_ranges: int = BROADCAST_RANGES) -> DataFrame:
    """``record``: the text of every record behind the headers."""
    states = range_states(lines.select("f", "b", "number", F.when(F.col("value").contains('"'), F.col("value")).alias("quoted")),
                          sep).persist()
    small = states.limit(broadcast_ranges + 1).count() <= broadcast_ranges
    tagged = lines.join(F.broadcast(states) if small else states, ["f", "b"])
    if not small:  # a shuffle mixes the lines; ranges come together and into order again
        tagged = tagged.repartition("f", "b").sortWithinPartitions("number")
    number = F.col("number")
    inner = tagged.where((number >= F.col("tail_until")) & (number < F.col("head_from"))).select("f", "b", "value")
    whole = inner.mapInArrow(lambda it: _records(it, sep), "record string")

    in_tail, is_head = number < F.col("tail_until"), number >= F.col("head_from")
    header = (F.col("b") == 0) & (F.col("head_from") == F.col("first"))
    parts = (lines.join(F.broadcast(states) if small else states, ["f", "b"]).where(in_tail | is_head)
             .select("f", F.when(in_tail, F.col("group")).otherwise(F.col("group") + 1).alias("g"),
                     F.struct("b", "number", "value").alias("line"), (header & is_head).alias("header")))
    crossing = parts.groupBy("f", "g").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.max("header").alias("header"))
    return whole.unionByName(crossing.where(~F.col("header")).select(
        F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("record")))


def read_csv_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns of CSV files with header as strings, as
    ``spark.read.csv(multiLine=True)`` gives them, split at byte ranges.

    Lines end with \\n or \\r\\n. A look at the lines with quotes tells whether
    any record has several; if none has, Spark's own reader splits the file.
    """
    options = {"header": True, "escape": '"', "sep": sep}
    columns = spark.read.options(**options, multiLine=True).csv(path).columns
    ship_package(spark)
    lines = csv_lines(spark, path)
    if not columns:
        return spark.read.options(**options, multiLine=True).csv(path)
    if not crosses_lines(lines, sep):
        return spark.read.options(**options, inferSchema=False).csv(path).toDF(*columns)
    record = F.when(F.col("record").endswith("\r"), F.expr("left(record, length(record) - 1)")).otherwise(F.col("record"))
    schema = ", ".join(f"c{i} string" for i in range(len(columns)))
    fields = F.from_csv("record", schema, {"escape": '"', "sep": sep, "multiLine": "true"})
    rows = csv_records(lines, sep).select(record.alias("record")).where(F.col("record") != "").select(fields.alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)])
