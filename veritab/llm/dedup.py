"""Operator 10: exact deduplication with counting quotient filters."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, lower_ascii, materialize, python_ready, row_struct, trimmed

#: The top bits of a fingerprint are its quotient: 4,096 runs, each merged by
#: one task; more for a larger corpus.
QUOTIENT_BITS = 12


class CountingQuotientFilter:
    """A lossless multiset of 64-bit fingerprints.

    A fingerprint is a quotient (its top bits) and a remainder (the rest). All
    remainders of a quotient form a run, sorted, with a count each, so filters
    merge run by run in one sorted pass and no count is ever estimated.
    """

    def __init__(self, runs: dict[int, tuple[np.ndarray, np.ndarray]], quotient_bits: int = QUOTIENT_BITS):
        self.runs, self.quotient_bits = runs, quotient_bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, quotient_bits: int = QUOTIENT_BITS) -> CountingQuotientFilter:
        values, counts = np.unique(fingerprints.astype(np.uint64), return_counts=True)
        shift = np.uint64(64 - quotient_bits)
        quotients = values >> shift
        remainders = values & np.uint64((1 << (64 - quotient_bits)) - 1)
        starts = np.flatnonzero(np.r_[True, quotients[1:] != quotients[:-1]]) if len(values) else np.array([], int)
        ends = np.r_[starts[1:], len(values)]
        return cls({int(quotients[a]): (remainders[a:b], counts[a:b]) for a, b in zip(starts, ends)}, quotient_bits)

    @staticmethod
    def merge_runs(runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """One run from several of the same quotient: equal remainders meet,
        their counts add up."""
        runs = list(runs)
        remainders = np.concatenate([r for r, _ in runs])
        counts = np.concatenate([c for _, c in runs])
        merged, place = np.unique(remainders, return_inverse=True)
        sums = np.zeros(len(merged), np.int64)
        np.add.at(sums, place, counts)
        return merged, sums

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        both = {q: self.merge_runs([f.runs[q] for f in (self, other) if q in f.runs])
                for q in sorted(self.runs.keys() | other.runs.keys())}
        return CountingQuotientFilter(both, self.quotient_bits)

    def items(self) -> Iterator[tuple[int, int]]:
        for q, (remainders, counts) in self.runs.items():
            for r, c in zip(remainders.tolist(), counts.tolist()):
                yield (q << (64 - self.quotient_bits)) | r, c


def _partition_filters(batches: Iterator[pd.DataFrame], quotient_bits: int) -> Iterator[pd.DataFrame]:
    parts = [np.unique(b["fp"].to_numpy(np.int64).view(np.uint64), return_counts=True) for b in batches]
    if not parts:
        return
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    merged, sums = CountingQuotientFilter.merge_runs([(values, counts)])
    built = CountingQuotientFilter.build(merged, quotient_bits)
    done = 0
    rows = []
    for q, (remainders, _) in built.runs.items():
        rows.append((q, remainders.astype("<u8").tobytes(), sums[done:done + len(remainders)].astype("<i8").tobytes()))
        done += len(remainders)
    yield pd.DataFrame(rows, columns=["quotient", "remainders", "counts"])


def _merge_quotient(pdf: pd.DataFrame, quotient_bits: int) -> pd.DataFrame:
    remainders, counts = CountingQuotientFilter.merge_runs(
        (np.frombuffer(r, "<u8"), np.frombuffer(c, "<i8")) for r, c in zip(pdf["remainders"], pdf["counts"]))
    many = counts > 1
    fps = (np.uint64(int(pdf["quotient"].iloc[0])) << np.uint64(64 - quotient_bits)) | remainders[many]
    return pd.DataFrame({"fp": fps.view(np.int64), "n": counts[many]})


def repeated_fingerprints(fingerprints: DataFrame, quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """``fp, n`` of every fingerprint (column ``fp``) that occurs more than
    once. Each partition builds one filter; a quotient's runs meet in one
    task, a run from a partition being one row however often a value occurs."""
    python_ready(fingerprints.sparkSession)
    runs = fingerprints.select("fp").mapInPandas(lambda it: trimmed(_partition_filters(it, quotient_bits)),
                                                 "quotient long, remainders binary, counts binary")
    return runs.groupBy("quotient").applyInPandas(lambda pdf: _merge_quotient(pdf, quotient_bits), "fp long, n long")


def duplicate_groups(docs: DataFrame, fingerprints: DataFrame, id_col: str, text_col: str,
                     quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """``text_sha256, keep_id, group_size`` of every text that occurs more than
    once. Texts whose fingerprint repeats are compared byte by byte: they are
    the key of a grouping that is combined before its shuffle, so a text with
    millions of copies moves once per task. The routing join is on the
    fingerprint alone and splits when one value is hot (adaptive skew join)."""
    repeated = repeated_fingerprints(fingerprints, quotient_bits).select("fp")
    texts = docs.select(col(id_col).alias("doc_id"), lower_ascii(F.coalesce(col(text_col), F.lit(""))).alias("norm"))
    return (texts.withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
            .groupBy("norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .where(F.col("group_size") > 1)
            .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"))


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``.

    Texts are equal when they are identical after lower-casing A-Z; a null
    text counts as empty, so all null and empty texts are one group. The row
    with the largest id stays (a null id is smaller than any other). Rows that
    repeat both the text and the largest id are the same document and are all
    marked as kept; ``drop_duplicates_exact`` leaves one of them. An empty
    table gives an empty result. Other columns are not read.
    """
    narrow = materialize(docs.select(
        col(id_col).alias("doc_id"), lower_ascii(F.coalesce(col(text_col), F.lit(""))).alias("norm"))
        .select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "dedup-ids")
    groups = duplicate_groups(docs, narrow, id_col, text_col, quotient_bits)
    return (narrow.join(groups, "text_sha256", "left")
            .select("doc_id",
                    F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                    F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                    (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
                    "text_sha256"))


def drop_duplicates_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          quotient_bits: int = QUOTIENT_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of equal texts one
    row, the one with the largest id. Of rows that repeat both text and id the
    one with the smallest hash of the whole row stays."""
    sha = F.sha2(lower_ascii(F.coalesce(col(text_col), F.lit(""))), 256).alias("text_sha256")
    narrow = materialize(docs.select(col(id_col).alias("doc_id"), sha, F.xxhash64(
        lower_ascii(F.coalesce(col(text_col), F.lit("")))).alias("fp")), "dedup-ids")
    groups = duplicate_groups(docs, narrow, id_col, text_col, quotient_bits)
    stay = (docs.select(row_struct(docs).alias("row"), col(id_col).alias("doc_id"), sha)
            .join(groups, "text_sha256", "left")
            .where(F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    again = materialize(narrow.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                        .select("text_sha256", F.col("doc_id").alias("again")), "dedup-again")
    if again.isEmpty():  # ids tell all rows apart
        kept = stay.select("row")
    else:
        same = [stay["text_sha256"] == again["text_sha256"], stay["doc_id"].eqNullSafe(again["again"])]
        kept = (stay.join(again, same, "left_anti").select("row")
                .union(stay.join(again, same, "left_semi").groupBy("text_sha256")
                       .agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
