"""Operator 1: quality classifier by a Kneser-Ney n-gram model."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, materialize, python_ready, small_side
from .shingles import text_groups

#: N-grams of UTF-8 bytes, at most seven. An n-gram's key is its length in the
#: highest byte over its bytes, so keys are exact.
ORDER = 6
LEVEL = 56
#: Bytes of text whose distinct n-grams are looked up together.
BLOCK_BYTES = 24 << 20
#: A language's documents stay up to this quantile of its trusted documents'
#: log perplexities plus the slack.
QUANTILE = 0.995
SLACK = 0.1
#: The grid of log perplexities on which quantiles are read.
STEP = 0.001


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with ``ORDER - 1`` zero bytes before each, and where their own bytes are."""
    lengths = np.diff(offsets)
    text = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(data)) + (ORDER - 1) * (text + 1)
    out = np.zeros(len(data) + (ORDER - 1) * len(lengths), np.uint64)
    out[at] = data
    return out, at


def _keys(padded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n-gram that ends at each place as an integer."""
    key = padded[at]
    for back in range(1, n):
        key = key | (padded[at - back] << np.uint64(8 * back))
    return key


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of the partition's highest-order n-grams."""
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held])
        counts = np.concatenate([c for _, c in held])
        values, place = np.unique(keys, return_inverse=True)
        return values, np.bincount(place, counts, len(values)).astype(np.int64)

    for batch in batches:
        for _, _, data, offsets in text_groups(batch.column("text")):
            padded, at = _padded(data, offsets)
            held.append(np.unique(_keys(padded, at, ORDER), return_counts=True))
            size += len(held[-1][0])
            if size > 4_000_000:
                held = [merged()]
                size = 0
    if held:
        values, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(counts)], names=["gram", "n"])


def _tail(grams: np.ndarray, k: int) -> np.ndarray:
    """The last ``k`` bytes of n-grams."""
    return grams & np.uint64((1 << (8 * k)) - 1)


def _level(grams: np.ndarray, k: int) -> np.ndarray:
    return grams | np.uint64(k << LEVEL)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def needed_keys(columns: Iterable[pa.Array]) -> np.ndarray:
    """The sorted keys that scoring these texts looks up: their distinct
    n-grams of each order and the contexts of these."""
    held = [_distinct(_keys(*_padded(data, offsets), ORDER))
            for column in columns for _, _, data, offsets in text_groups(column)]
    grams = _distinct(np.concatenate(held)) if held else np.array([], np.uint64)
    keys = []
    for k in range(1, ORDER + 1):
        own = _distinct(_tail(grams, k))
        keys += [_level(own, k), _level(_distinct(own >> np.uint64(8)), k - 1)]
    return _distinct(np.concatenate(keys))


@dataclass
class KneserNey:
    """Interpolated modified Kneser-Ney: p_k(w | c) = found_k[c w] +
    backoff_k[c] * p_{k-1}(w | c without its first byte), p_0 uniform.
    ``rows`` has (key, found, backoff): an n-gram's own part and what it leaves
    to the order below when it is a context."""

    rows: DataFrame

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All of it as sorted arrays, for small models."""
        t = self.rows.orderBy("key").toArrow()
        return t["key"].to_numpy().astype(np.uint64), t["found"].to_numpy(), t["backoff"].to_numpy()


def fit_kneser_ney(texts: DataFrame) -> KneserNey:
    """Fit on all rows of ``texts`` (text). Counts are sharded by n-gram. The
    highest order counts occurrences, lower orders the different bytes before
    an n-gram. N-grams are joined with their contexts' counts, shard by shard;
    the discounts D1, D2, D3+ come from the counts of counts of each order."""
    counts = materialize(texts.mapInArrow(_gram_counts, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")),
                         "lm-counts")
    parts = []
    level = counts
    for k in range(ORDER, 0, -1):
        shard = level.withColumn("context", F.shiftright("gram", 8))
        seen = {r["n"]: r["m"] for r in level.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
        n1, n2, n3, n4 = (max(1, seen.get(i, 0)) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d1, d2, d3 = (min(i, max(0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = shard.groupBy("context").agg(F.sum("n").alias("total"), F.sum(discount).alias("held"))
        parts.append(shard.join(contexts, "context").select(
            F.col("gram").bitwiseOR(F.lit(k << LEVEL)).alias("key"),
            ((F.col("n") - discount) / F.col("total")).cast("float").alias("found"), F.lit(None).cast("float").alias("backoff")))
        parts.append(contexts.select(F.col("context").bitwiseOR(F.lit((k - 1) << LEVEL)).alias("key"), F.lit(None).cast("float"),
                                     (F.col("held") / F.col("total")).cast("float")))
        level = materialize(level.groupBy(F.col("gram").bitwiseAND((1 << (8 * (k - 1))) - 1).alias("gram")).agg(
            F.count(F.lit(1)).alias("n")), "lm-level") if k > 1 else None
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    return KneserNey(materialize(every.groupBy("key").agg(
        F.coalesce(F.max("found"), F.lit(0.0).cast("float")).alias("found"),
        F.coalesce(F.max("backoff"), F.lit(1.0).cast("float")).alias("backoff")), "lm-model"))


def _look_up(wanted: np.ndarray, keys: np.ndarray, *columns: tuple[np.ndarray, float]) -> list[np.ndarray]:
    """Values of the wanted keys in columns of a sorted table, each with its default."""
    if not len(keys):
        return [np.full(len(wanted), default, np.float32) for _, default in columns]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return [np.where(hit, values[at], np.float32(default)) for values, default in columns]


def text_log_probs(column: pa.Array, keys: np.ndarray, found: np.ndarray, backoff: np.ndarray) -> Iterator[tuple[float, int]]:
    """(sum of log probabilities, bytes) of each text. A byte's probability
    depends on its n-gram only, so distinct n-grams are looked up once."""
    for _, _, data, offsets in text_groups(column):
        grams, place = np.unique(_keys(*_padded(data, offsets), ORDER), return_inverse=True)
        p = np.full(len(grams), 1 / 256)
        for k in range(1, ORDER + 1):
            own = _tail(grams, k)
            p = (_look_up(_level(own, k), keys, (found, 0.0))[0]
                 + _look_up(_level(own >> np.uint64(8), k - 1), keys, (backoff, 1.0))[0] * p)
        sums = np.r_[0.0, np.cumsum(np.log(np.maximum(p, 1e-12))[place])]
        yield from zip((sums[offsets[1:]] - sums[offsets[:-1]]).tolist(), np.diff(offsets).tolist())


def _packed(values: np.ndarray) -> bytes:
    """Compressed byte by byte of the numbers: first bytes, second bytes, ..."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 6).compress(planes, asbytes=True)


def _unpacked(packed: pa.Scalar, kind: type) -> np.ndarray:
    size, item = int.from_bytes(packed.as_py()[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed.as_py()[8:], size * item), np.uint8)
    return np.ascontiguousarray(planes.reshape(item, size).T).view(kind).ravel()


def _pages(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """(block, page): pages are up to a MB of rows, compressed; dealt by their bytes."""
    for batch in batches:
        for first, end, _, _ in text_groups(batch.column("text")):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
                out.write_batch(batch.slice(first, end - first))
            page = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([zlib.crc32(page) % blocks], pa.int64()), pa.array([page], pa.binary())],
                                             names=["block", "page"])


def _rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for page in table["page"]:
        yield from pa.ipc.open_stream(page.as_buffer())


def _requests(table: pa.Table, shards: int) -> pa.Table:
    """(block, shard, keys) of a block of texts: what it asks each shard of the model."""
    keys = needed_keys(batch.column("text") for batch in _rows(table))
    shard = keys % np.uint64(shards)
    own = [(s, keys[shard == s]) for s in np.unique(shard).tolist()]
    steps = [_packed(np.diff(k, prepend=np.uint64(0))) for _, k in own]
    return pa.table({"block": pa.array([table["block"][0].as_py()] * len(own), pa.int64()),
                     "shard": pa.array([s for s, _ in own], pa.int64()), "steps": pa.array(steps, pa.binary())})


def _answers(model: pa.Table, requests: pa.Table) -> pa.Table:
    """The requests with the model's values of the keys that it has."""
    order = np.argsort(keys := model["key"].to_numpy().astype(np.uint64))
    keys, found, backoff = keys[order], model["found"].to_numpy()[order], model["backoff"].to_numpy()[order]
    out = []
    for steps in requests["steps"]:
        wanted = np.cumsum(_unpacked(steps, np.uint64), dtype=np.uint64)
        f, b = _look_up(wanted, keys, (found, 0.0), (backoff, 1.0))
        has = (f != 0.0) | (b != 1.0)
        out.append((_packed(np.diff(wanted[has], prepend=np.uint64(0))), _packed(f[has]), _packed(b[has])))
    return pa.table({"block": requests["block"],
                     **{n: pa.array([r[i] for r in out], pa.binary()) for i, n in enumerate(("steps", "found", "backoff"))}})


def _block_scores(texts: pa.Table, answers: pa.Table) -> pa.Table:
    parts = [(np.cumsum(_unpacked(s, np.uint64), dtype=np.uint64), _unpacked(f, np.float32), _unpacked(b, np.float32))
             for s, f, b in zip(answers["steps"], answers["found"], answers["backoff"])]
    keys, found, backoff = (np.concatenate(c) for c in zip(*parts)) if parts else (np.array([], t) for t in (np.uint64, "f4", "f4"))
    order = np.argsort(keys)
    model = keys[order], found[order], backoff[order]
    out = []
    for batch in _rows(texts):
        each = [-s / n if n else None for s, n in text_log_probs(batch.column("text"), *model)]
        out.append(pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "trusted")), pa.array(each, pa.float64())],
                                              names=["doc_id", "lang", "trusted", "log_perplexity"]))
    return pa.Table.from_batches(out)


def score_texts(source: DataFrame, model: KneserNey) -> DataFrame:
    """``doc_id, lang, trusted, log_perplexity`` of ``source`` (with ``text``).
    Texts are dealt into blocks by hash, compressed; a block's distinct n-grams
    are sent to the shards of the model, and what they find comes back to it.
    Blocks and shards grow in number with the text, not in size."""
    spark = source.sparkSession
    size = source.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(2 * spark.sparkContext.defaultParallelism, size // BLOCK_BYTES) | 1
    kind = source.schema["doc_id"].dataType.simpleString()
    dealt = source.select("doc_id", "lang", "trusted", "text").mapInArrow(
        lambda it: _pages(it, n), "block long, page binary").repartition(4 * n, "block")
    requests = dealt.groupBy("block").applyInArrow(lambda t: _requests(t, n), "block long, shard long, steps binary")
    answers = (model.rows.groupBy(F.pmod("key", F.lit(n)).alias("shard")).cogroup(requests.groupBy("shard"))
               .applyInArrow(_answers, "block long, steps binary, found binary, backoff binary"))
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _block_scores, f"doc_id {kind}, lang string, trusted boolean, log_perplexity double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  lang_col: str = "lang", label_col: str = "quality", quantile: float = QUANTILE,
                  slack: float = SLACK) -> DataFrame:
    """``doc_id, lang, perplexity, threshold, kept`` of every row of ``docs``.

    Documents with label 1 are the trusted text: a Kneser-Ney model of byte
    n-grams is fitted on all of them and scores every document's whole text;
    perplexity is per byte. A language's threshold is the ``quantile`` of its
    trusted documents (on a grid of 0.001 of the logarithm) times exp(slack);
    a document stays up to it.

    A null or empty text has perplexity null and is not kept. A null language
    is one of its own; a language without trusted documents has threshold null
    and keeps what has text. Of repeated labels the largest counts, null ids
    match no label, repeated documents are scored alike. Without any trusted
    text every byte has probability 1/256 and every text is kept. An empty
    table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    python_ready(spark)
    trusted = (labels.where(col(label_col) == 1).select(col(id_col).alias("doc_id")).where("doc_id is not null").distinct()
               .withColumn("trusted", F.lit(True)))
    source = (docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"),
                          col(lang_col).cast("string").alias("lang"))
              .join(small_side(trusted), "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False))))
    model = fit_kneser_ney(source.where("trusted").select("text"))
    scored = materialize(score_texts(source, model), "lm-scores")
    grid = (scored.where("trusted and log_perplexity is not null")
            .groupBy("lang", F.ceil(F.col("log_perplexity") / STEP).alias("cell")).agg(F.count(F.lit(1)).alias("n")))
    upto = W.partitionBy("lang").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    thresholds = (grid.withColumn("below", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("lang")))
                  .where(F.col("below") >= F.col("all") * quantile).groupBy("lang").agg(F.min("cell").alias("cell"))
                  .select(F.col("lang").alias("of"), (F.col("cell") * STEP + slack).alias("limit")))
    return (scored.join(thresholds, F.col("lang").eqNullSafe(F.col("of")), "left")
            .select("doc_id", "lang", F.exp("log_perplexity").alias("perplexity"), F.exp("limit").alias("threshold"),
                    F.coalesce(F.col("log_perplexity") <= F.coalesce("limit", F.lit(float("inf"))), F.lit(False)).alias("kept")))
