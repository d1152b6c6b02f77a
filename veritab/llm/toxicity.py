"""Operator 6: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, python_ready, trimmed

#: The fit reads at most so many labelled rows, those with the smallest hash of the id.
TRAIN_ROWS = 12_000
HASH_BITS = 20
#: A word gives itself and its beginnings of these lengths as terms.
PREFIXES = (4, 5, 6, 7, 8)
#: Terms enter the machine from these z-scores on: of their own class difference,
#: or of an interaction with another term (there are millions of pairs).
MIN_Z, PAIR_Z = 5.0, 8.0
#: Terms that are screened for interactions besides those that differ by
#: themselves: those that part the sample most evenly. It bounds the pairs.
PAIR_TERMS = 512
#: Terms of a block of pairs, so that the driver holds few pairs at a time.
PAIR_BLOCK = 256
FACTORS = 4
LETTERS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 400_000


def word_terms(word: str) -> list[int]:
    """Hashed terms of a lower-cased word: the word and its beginnings."""
    mask = (1 << HASH_BITS) - 1
    terms = [zlib.crc32(b"=" + word.encode("utf-8", "surrogatepass")) & mask]
    return terms + [zlib.crc32(word[:k].encode("utf-8", "surrogatepass")) & mask for k in PREFIXES if len(word) > k]


def text_words(text: str) -> set[str]:
    return set(LETTERS.findall(text.lower()))


def text_terms(text: str) -> np.ndarray:
    """Hashed terms of a text's distinct words, one entry per word and term."""
    return np.array([t for w in text_words(text) for t in word_terms(w)], np.int32)


@dataclass
class FactorizationMachine:
    """score = sigmoid(bias + sum w + 1/2 (|sum v|^2 - sum |v|^2)), the sums
    over all (distinct word, term) pairs of a text, so a word's share of each
    sum can be remembered; terms that were not selected weigh nothing."""

    terms: np.ndarray  # sorted hashed terms
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def fit(cls, terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS,
            epochs: int = 300, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> FactorizationMachine:
        """Full-batch Adam on the logistic loss; ``rows`` are indices into
        ``terms``. Deterministic for the same rows in the same order."""
        rng = np.random.default_rng(seed)
        n, m = len(rows), len(terms)
        params = {"b": np.zeros(1), "w": np.zeros(m), "v": rng.normal(0, 0.05, (m, factors))}
        doc = np.repeat(np.arange(n), [len(r) for r in rows])
        at = np.concatenate(rows) if n else np.array([], int)
        y = labels.astype(float)
        if not len(y) or not m or y.min() == y.max():  # nothing to tell apart
            rate_of = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
            return cls(terms, float(np.log(rate_of / (1 - rate_of))), np.zeros(m), np.zeros((m, factors)))
        state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in params.items()}

        def by(index, weights, size):
            return np.bincount(index, weights, size)

        for step in range(1, epochs + 1):
            w, v = params["w"], params["v"]
            sums = np.stack([by(doc, v[at, f], n) for f in range(factors)], 1)
            squares = by(doc, (v[at] ** 2).sum(1), n)
            z = params["b"][0] + by(doc, w[at], n) + 0.5 * ((sums ** 2).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            pull = error[doc]
            grads = {"b": np.array([error.sum()]), "w": by(at, pull, m) + l2 * w,
                     "v": np.stack([by(at, pull * (sums[doc, f] - v[at, f]), m) for f in range(factors)], 1) + l2 * v}
            for k, g in grads.items():
                first, second = state[k]
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                params[k] = params[k] - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        return cls(terms, float(params["b"][0]), params["w"], params["v"])

    def word_share(self, word: str) -> np.ndarray | None:
        """(sum w, sum |v|^2, sum v) of a word's selected terms, or None."""
        found = [i for t in word_terms(word) if (i := np.searchsorted(self.terms, t)) < len(self.terms)
                 and self.terms[i] == t]
        if not found:
            return None
        v = self.factors[found]
        return np.concatenate([[self.linear[found].sum(), (v ** 2).sum()], v.sum(0)])

    def score(self, shares: list[np.ndarray]) -> float:
        z = self.bias
        if shares:
            total = np.sum(shares, 0)
            z += total[0] + 0.5 * ((total[2:] ** 2).sum() - total[1])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            counts[label, np.unique(text_terms(text))] += 1
    seen = np.flatnonzero(counts.sum(0))
    if len(seen):
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[1][seen]), pa.array(counts[0][seen])],
                                         names=["term", "pos", "neg"])


def _selected(batches: Iterator[pa.RecordBatch], terms: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            own = text_terms(text)
            at = np.searchsorted(terms, own)
            at = at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == own)] if len(terms) else at[:0]
            rows.append(np.sort(at).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.binary())],
                                         names=["doc_id", "label", "terms"])


def _text_scores(batches: Iterator[pa.RecordBatch], model: FactorizationMachine,
                 text_col: str) -> Iterator[tuple[pa.RecordBatch, list[float]]]:
    shares: dict[str, np.ndarray | None] = {}
    for batch in batches:
        out = []
        for text in batch.column(text_col).to_pylist():
            words = text_words(text or "")
            if len(shares) > CACHE_WORDS:
                shares = {}
            for w in words.difference(shares):
                shares[w] = model.word_share(w)
            # a fixed order of the words makes the sum the same in every run
            out.append(model.score([shares[w] for w in sorted(words) if shares[w] is not None]))
        yield batch, out


def _scores(batches: Iterator[pa.RecordBatch], model: FactorizationMachine) -> Iterator[pa.RecordBatch]:
    for batch, out in _text_scores(batches, model, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())],
                                         names=["doc_id", "score"])


def _harmless(batches: Iterator[pa.RecordBatch], model: FactorizationMachine, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch, out in _text_scores(batches, model, text_col):
        yield batch.filter(pa.array([s < 0.5 for s in out], pa.bool_()))


def interacting_terms(x: np.ndarray, labels: np.ndarray, min_z: float = PAIR_Z) -> np.ndarray:
    """Columns of the 0/1 matrix ``x`` that interact with another one: the log
    odds of label 1 in the four cells of two terms (both, one, the other,
    neither) differ by more than the sum of the terms' own differences.

    The contrast is l11 - l10 - l01 + l00, with half a row added to each count,
    over its standard error; cells of fewer than five rows tell nothing.
    """
    n, hits, m = len(x), int((labels == 1).sum()), x.shape[1]
    ones, pos = x.sum(axis=0, dtype=np.int64).astype(float), x[labels == 1].sum(axis=0, dtype=np.int64).astype(float)
    found = np.zeros(m, bool)
    for i in range(0, m, PAIR_BLOCK):
        left = x[:, i:i + PAIR_BLOCK].astype(np.float32)
        for j in range(i, m, PAIR_BLOCK):
            right = x[:, j:j + PAIR_BLOCK].astype(np.float32)
            both, both_pos = (left.T @ right).astype(float), (left[labels == 1].T @ right[labels == 1]).astype(float)
            a, b = ones[i:i + PAIR_BLOCK, None], ones[None, j:j + PAIR_BLOCK]
            p, q = pos[i:i + PAIR_BLOCK, None], pos[None, j:j + PAIR_BLOCK]
            contrast, variance, enough = 0.0, 0.0, np.ones(both.shape, bool)
            for sign, size, own in ((1, both, both_pos), (-1, a - both, p - both_pos), (-1, b - both, q - both_pos),
                                    (1, n - a - b + both, hits - p - q + both_pos)):
                contrast = contrast + sign * np.log((own + 0.5) / (size - own + 0.5))
                variance = variance + 1 / (own + 0.5) + 1 / (size - own + 0.5)
                enough &= size >= 5
            if i == j:
                np.fill_diagonal(enough, False)
            tells = enough & (np.abs(contrast) >= min_z * np.sqrt(variance))
            found[i:i + PAIR_BLOCK] |= tells.any(axis=1)
            found[j:j + PAIR_BLOCK] |= tells.any(axis=0)
    return np.flatnonzero(found)


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, label, text`` of at most ``limit`` labelled documents. The
    bounded label table is broadcast; documents are read where they are."""
    own = (labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    return docs.join(F.broadcast(own), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text")


def fit_toxicity(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, label 0/1), which
    holds training rows only. Terms are screened over the bounded sample, alone
    (a two-proportion z-score) and in pairs, so that terms which tell something
    only together enter the machine as well."""
    python_ready(docs.sparkSession)
    rows = training_rows(docs, labels, limit)
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
    size = {r["label"]: r["n"] for r in n}
    pos, neg = size.get(1, 0), size.get(0, 0)
    alone = frequent = np.array([], np.int32)
    if pos and neg:
        share = (F.col("pos") + F.col("neg")) / (pos + neg)
        z = (F.col("pos") / pos - F.col("neg") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
        counts = materialize(rows.mapInArrow(lambda it: trimmed(_term_counts(it)), "term long, pos long, neg long")
                             .groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "toxic-terms")
        differs = F.abs(z) >= MIN_Z
        alone = np.array([r["term"] for r in counts.where(differs).select("term").collect()], np.int32)
        evenly = counts.where(~differs).orderBy(F.desc(share * (1 - share)), "term").limit(PAIR_TERMS)
        frequent = np.array([r["term"] for r in evenly.select("term").collect()], np.int32)
    terms = np.sort(np.concatenate([alone, frequent]))
    # one row per id, so that what is collected is bounded by the sample
    own = (rows.mapInArrow(lambda it: trimmed(_selected(it, terms)),
                           f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, terms binary")
           .groupBy("doc_id", "label").agg(F.min("terms").alias("terms")))
    got = sorted(own.collect(), key=lambda r: (r["doc_id"], r["label"], r["terms"]))
    at = [np.frombuffer(r["terms"], "<i4").astype(int) for r in got]
    y = np.array([r["label"] for r in got], int)
    x = np.zeros((len(got), len(terms)), np.uint8)
    for k, row in enumerate(at):
        x[k, row] = 1
    keep = np.isin(terms, alone)
    if len(got):
        keep[interacting_terms(x, y)] = True
    place = np.cumsum(keep) - 1
    return FactorizationMachine.fit(terms[keep], [place[row[keep[row]]] for row in at], y)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", limit: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    ``held_out`` is crc32(id as text) mod 5 = 0; such rows are never trained
    on. The score reads the text alone: its distinct words of letters, lower
    case, and their beginnings, hashed. ``predicted`` is 1 from 0.5 on.

    A null or empty text has no terms and scores the bias; a null id is held
    out as the empty text is. Labels other than 0 and 1, null ids and labels
    without a document are ignored; of repeated labels the largest counts; of
    rows that repeat a labelled id one is learnt from. Without labels of both
    classes every score is the (clipped) share of label 1, 0.001 if there are
    none. An empty table gives no rows. Other columns are not read.
    """
    source, model = _fitted(docs, labels, id_col, text_col, label_col, limit)
    kind = source.schema["doc_id"].dataType.simpleString()
    return (source.mapInArrow(lambda it: trimmed(_scores(it, model)), f"doc_id {kind}, score double")
            .select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"),
                    "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")))


def fold_of(key: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
            limit: int) -> tuple[DataFrame, FactorizationMachine]:
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    seen = labels.select(col(id_col).alias("doc_id"), col(label_col).alias("label"))
    return source, fit_toxicity(source, seen.where(fold_of(F.col("doc_id")) != 0), limit)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", limit: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all its columns; they
    pass through the scoring and are not joined. Fitted as in ``score_toxicity``."""
    _, model = _fitted(docs, labels, id_col, text_col, label_col, limit)
    return docs.mapInArrow(lambda it: trimmed(_harmless(it, model, text_col)), docs.schema)
