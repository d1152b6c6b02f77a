"""Operator 7: quality rules and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BLANK, BLANKS, col, materialize, small_side

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Hash buckets of the two multinomials and the count added to each.
BUCKETS = 1 << 16
SMOOTHING = 1.0
#: Documents stay from this quantile of the trusted documents' ratios less the slack on.
QUANTILE = 0.005
SLACK = 0.02
STEP = 0.001


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def deleted(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(deleted(x, BLANKS)) > 0)
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeated_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words`` from ``words``: the words in windows of three that
    occur twice or more. Windows are compared by a 64-bit hash; only texts with
    a repeated one sort theirs by it, and neighbours of equal hash are marked."""
    n = F.size("words")
    hashes = F.transform(F.slice("words", F.lit(1), F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(
        w, F.get("words", i + 1), F.get("words", i + 2)))
    df = df.withColumn("windows", hashes)
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed))

    def repeated(s: Column, k: Column) -> Column:
        same = lambda j: F.coalesce(F.get("windows", j)["h"] == s["h"], F.lit(False))
        return F.when(same(k - 1) | same(k + 1), F.array(s["i"], s["i"] + 1, s["i"] + 2)).otherwise(
            F.array().cast("array<int>"))

    covered = F.size(F.array_distinct(F.flatten(F.transform("windows", repeated))))
    return df.withColumn("n_repeat_words", F.when(F.col("windows").isNull(), 0).otherwise(covered).cast("long")).drop("windows")


def term_buckets(words: str) -> Column:
    """Hash buckets of the words and of the pairs of neighbouring words."""
    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")

    pairs = F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(F.transform(words, lambda w: bucket(w)),
                    F.transform(pairs, lambda w, i: bucket(w, F.get(words, i + 1))))


def log_ratios(source: DataFrame) -> list[float]:
    """log P(bucket | trusted) - log P(bucket | all) of each bucket, from the
    terms of all documents (columns ``words``, ``trusted``)."""
    counts = (source.select(F.explode(term_buckets("words")).alias("bucket"), "trusted").groupBy("bucket")
              .agg(F.count(F.lit(1)).alias("raw"), F.count_if("trusted").alias("target")).collect())
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    total_raw, total_target = sum(raw) + SMOOTHING * BUCKETS, sum(target) + SMOOTHING * BUCKETS
    return [round(math.log((t + SMOOTHING) / total_target) - math.log((r + SMOOTHING) / total_raw), 6)
            for t, r in zip(target, raw)]


def score_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """Rule counts, ratio and verdict of every row of ``docs``: ``doc_id,
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, ratio``.

    ``ratio`` is the mean over a text's words and neighbouring pairs of the
    log-likelihood ratio between two multinomials over 65,536 hash buckets:
    that of the trusted documents (label 1) and that of all documents. A
    document is kept if it does not fail the base rules and its ratio reaches
    the ``quantile`` of the trusted documents that pass them, less ``slack``.

    The trusted ids are broadcast if they are few (counted first) and joined
    by a shuffle otherwise; the bucket counts are combined before they move and
    are 65,536 rows at any scale. A null or empty text has no words, ratio 0,
    and fails the base rules. Null ids match no label; of repeated labels the
    largest counts; repeated rows are scored alike. Without trusted documents
    only the base rules decide. An empty table gives no rows. Other columns
    are not read.
    """
    trusted = (labels.where(col(label_col) == 1).select(col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
               .withColumn("trusted", F.lit(True)))
    source = (docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
              .join(small_side(trusted), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
              .withColumn("words", words_of(F.col("text"))))
    ratios = F.split(F.lit(",".join(map(str, log_ratios(source)))), ",").cast("array<double>")
    counted = source.select(
        "doc_id", "trusted", "words", F.size("words").cast("long").alias("n_words"),
        F.length(deleted(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(deleted(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("text")).alias("n_dup_lines"))
    terms = term_buckets("words")
    scored = (with_repeated_words(counted)
              .withColumn("ratio", F.when(F.col("n_words") > 0, F.aggregate(
                  terms, F.lit(0.0), lambda total, b: total + F.get(ratios, b)) / (2 * F.col("n_words") - 1)).otherwise(0.0))
              .withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                          | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
              .drop("words"))
    scored = materialize(scored, "rules")
    grid = (scored.where("trusted and not base_failed").groupBy(F.floor(F.col("ratio") / STEP).alias("cell"))
            .agg(F.count(F.lit(1)).alias("n")))
    everything = W.partitionBy()
    cell = (grid.withColumn("below", F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("all", F.sum("n").over(everything)).where(F.col("below") >= F.col("all") * quantile)
            .agg(F.min("cell").alias("cell")).first()["cell"])
    limit = -math.inf if cell is None else cell * STEP - slack
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & (F.col("ratio") >= F.lit(limit))).alias("kept"), "ratio")
