"""Operator 8: best-fit-decreasing packing of tokenised documents."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import byte_slices, col, materialize, python_ready, release_memory, trimmed

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Pieces of one length are ranked in so many groups, so that a hot length
#: (that of full pieces) is no single task.
RANK_BUCKETS = 1024
#: Bytes of text that a worker tokenises at once, and words per call.
SLICE_BYTES, CALL_WORDS = 2 << 20, 4096
#: White space at a word's start (what a tokenizer may count as such, and more).
GLUED = "^$|^[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


#: Words of these characters split alike in all Unicode versions.
PLAIN = "^[\\x00-\\x{52f}]*$"


def plain_encoder(description: dict):
    """The same byte-pair encoding by ``tiktoken``, several times as fast, for
    words of plain characters; None if the tokenizer is not of that kind (no
    normaliser, the usual split, ids in the order of the merges)."""
    import public_tokenizers
    import tiktoken
    model, split = description["model"], description.get("pre_tokenizer") or {}
    # byte-level tokens spell bytes as printable characters: those that are ones as themselves, the others from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    if (model.get("type") != "BPE" or description.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                                              "end_of_word_suffix", "byte_fallback", "ignore_merges"))):
        return None
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    if any(model["vocab"].get(m.replace(" ", "")) != 256 + k for k, m in enumerate(merges)):
        return None
    tokens = sorted(model["vocab"], key=model["vocab"].get)[:256 + len(merges)]
    ranks = {bytes(spelled[c] for c in t): k for k, t in enumerate(tokens)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ranges(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``pool`` one behind the other."""
    ends = np.cumsum(sizes)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


class WordTokenizer:
    """Token ids of whole texts, the same as the tokenizer's own.

    In this byte-level BPE a blank before a character that is no white space
    always starts a new pre-token, so a text may be cut there and each cut
    tokenised alone. Arrow cuts the texts of a slice and finds the distinct
    words; those are tokenised thousands at a time, one behind the other (only
    a word's first token starts with a blank, which tells them apart), and
    numpy puts the texts' ids together. Cuts in runs of white space are undone.
    A text with a special token goes to the tokenizer whole.
    """

    def __init__(self, tokenizer, specials: Iterable[str] = ()):
        self.tokenizer, self.specials = tokenizer, tuple(specials)
        self.starts_blank = np.array([t is not None and t.startswith("\u0120") for t in map(
            tokenizer.id_to_token, range(tokenizer.get_vocab_size()))])
        self.plain = plain_encoder(json.loads(tokenizer.to_str()))

    @classmethod
    def load(cls, name: str) -> WordTokenizer:
        from tokenizers import Tokenizer
        path = name
        if not os.path.isabs(name):
            import public_tokenizers
            path = public_tokenizers.path(name)
        tokenizer = Tokenizer.from_file(path)
        return cls(tokenizer, [t.content for t in tokenizer.get_added_tokens_decoder().values()])

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4")
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def distinct_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words, each behind a blank, that hold no blank and
        start with no white space."""
        plain = (pc.match_substring_regex(words, PLAIN).to_numpy(zero_copy_only=False) if self.plain is not None
                 else np.zeros(len(words), bool))
        sizes, parts, begins = np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
        done = 0
        for own in (plain, ~plain):
            texts = words.filter(pa.array(own))
            edges = pa.array([*range(0, len(texts), CALL_WORDS), len(texts)], pa.int32())
            calls = [" " + c for c in pc.binary_join(pa.ListArray.from_arrays(edges, texts), " ").to_pylist()] if len(texts) else []
            if own is plain:
                found = [self.plain.encode_to_numpy(c) for c in calls]
            else:
                found = [i for at in range(0, len(calls), 16) for i in self.raw(calls[at:at + 16])]
            ids = np.concatenate([np.zeros(0, "<u4"), *found])
            at = np.flatnonzero(self.starts_blank[ids])
            if len(at) != len(texts):
                raise ValueError("the tokenizer does not start a token at every blank")
            sizes[own], begins[own] = np.diff(at, append=len(ids)), done + at
            parts.append(ids)
            done += len(ids)
        return ranges(np.concatenate(parts), begins, sizes), sizes

    def encode_slice(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts one behind the other, and how
        many each text has."""
        whole = [k for k, hit in enumerate(self._special(texts)) if hit]
        if whole:
            own = self.raw([texts[k].as_py() for k in whole])
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), whole)), "", texts)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, flat = offsets - offsets[0], parts.flatten().dictionary_encode()
        distinct, codes = flat.dictionary, flat.indices.to_numpy().astype(np.int64)
        begins = offsets[:-1]
        first = np.zeros(len(codes), bool)
        first[begins] = True
        odd = pc.match_substring_regex(distinct, GLUED).to_numpy(zero_copy_only=False)
        glued = odd[codes] & ~first
        n_words = len(distinct)
        starts, extra = distinct.take(pa.array(codes[begins])).to_pylist(), {}
        if glued.any():  # a run of such parts belongs to the word in front of it
            at = np.flatnonzero(glued)
            heads = at[np.concatenate([[True], np.diff(at) > 1])] - 1
            ends = at[np.concatenate([np.diff(at) > 1, [True]])] + 1
            text_of = np.searchsorted(offsets, heads, side="right") - 1
            lengths = ends - heads
            runs = distinct.take(pa.array(ranges(codes, heads, lengths)))
            edges = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(edges, runs), " ").to_pylist()
            for head, k, own_text in zip(heads.tolist(), text_of.tolist(), joined):
                if first[head]:
                    starts[k] = own_text
                else:
                    codes[head] = n_words + extra.setdefault(own_text, len(extra))
        keep = ~glued
        counts = np.add.reduceat(keep.astype(np.int64), begins) if len(codes) else np.zeros(0, np.int64)
        # entries: the distinct words, the glued ones, and each text's start, which has no blank in front
        codes[begins] = n_words + len(extra) + np.arange(len(texts))
        used = np.unique(codes[keep])
        used = used[used < n_words]
        ids, own_sizes = self.distinct_ids(distinct.take(pa.array(used)))
        single = self.raw([" " + w for w in extra]) + self.raw(starts)
        for k, n in enumerate(whole):
            single[len(extra) + n] = own[k]
        sizes = np.zeros(n_words + len(single), np.int64)
        sizes[used] = own_sizes
        sizes[n_words:] = [len(i) for i in single]
        # the ids lie in the order of the entries, as the used words are sorted
        pool = np.concatenate([ids, *single])
        place = np.cumsum(sizes) - sizes
        codes = codes[keep]
        size = sizes[codes]
        return ranges(pool, place[codes], size), np.add.reduceat(size, np.cumsum(counts) - counts) if len(counts) else counts

    def _special(self, texts: pa.StringArray) -> list[bool]:
        hits = np.zeros(len(texts), bool)
        for s in self.specials:
            hits |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return hits.tolist()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not texts:
            return []
        ids, counts = self.encode_slice(pa.array(texts, pa.string()))
        return [p.tobytes() for p in np.split(ids, np.cumsum(counts)[:-1])]


_LOADED: dict[str, WordTokenizer] = {}


def _tokenizer(name: str) -> WordTokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core already
    if name not in _LOADED:
        _LOADED[name] = WordTokenizer.load(name)
        release_memory()  # the parsed tokenizer file
    return _LOADED[name]


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first is shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(batches: Iterator[pa.RecordBatch], name: str, capacity: int, end_id: int,
            with_ids: bool) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(name)
    end = np.asarray([end_id], "<u4").tobytes()
    for batch in batches:
        sizes = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        for first, last in byte_slices(sizes, SLICE_BYTES):
            part = batch.slice(first, last - first)
            flat, counts = tokenizer.encode_slice(part.column("text"))
            raw, at, rows = flat.tobytes(), 0, []
            for k, n in enumerate(counts.tolist()):
                for piece, (start, length) in enumerate(piece_bounds(n + 1, capacity)):
                    # only a text's last piece holds the end id
                    own = raw[at + 4 * start:at + 4 * min(start + length, n)] + (end if start + length > n else b"")
                    rows.append((k, piece, start, length, zlib.crc32(own), own if with_ids else None))
                at += 4 * n
            back, piece, start, length, crc, own = zip(*rows)
            arrays = [part.column("doc_id").take(pa.array(back, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                      pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(own, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            release_memory()


class CapacityTree:
    """A segment tree over remaining capacities 0..capacity; a leaf tells
    whether a bin with that much room is open."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.node = [False] * (2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.size
        self.node[i] = is_open
        while i > 1:
            i //= 2
            self.node[i] = self.node[2 * i] or self.node[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The smallest open capacity of at least ``need``."""
        i = need + self.size
        while not self.node[i]:
            while i & 1:  # a right child: nothing further in this subtree
                i //= 2
                if i <= 1:
                    return None
            i += 1
        while i < self.size:
            i = 2 * i if self.node[2 * i] else 2 * i + 1
        return i - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over ``counts`` items of each length.

    Items of a length are alike, and so are open bins with the same room, so
    both are handled as ranges: the seats ``(length, first_rank, count,
    first_bin, per_bin, offset)`` say that the items of that length with ranks
    from ``first_rank`` on go to bins from ``first_bin`` on, ``per_bin`` each,
    from ``offset`` on. That is what placing one item after the other gives:
    the tightest bin stays the tightest until it can't hold the length any
    more. A length splits at most two ranges, so seats number a few times
    ``capacity`` whatever the number of items. Also returns the number of bins.
    """
    tree, room, bins = CapacityTree(capacity), {c: [] for c in range(capacity + 1)}, 0
    seats = []

    def put(c: int, first: int, n: int) -> None:
        if n and c:
            room[c].append((first, n))
            tree.set(c, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            c = tree.tightest(length)
            if c is None:
                new = -(-left // (capacity // length))
                put(capacity, bins, new)
                bins += new
                continue
            first, n = room[c].pop()
            each = c // length
            full = min(n, left // each)
            if full:
                seats.append((length, rank, full * each, first, each, capacity - c))
                rank, left = rank + full * each, left - full * each
            rest_first, rest = first + full, n - full
            if left and rest:
                seats.append((length, rank, left, rest_first, each, capacity - c))
                put(c - left * length, rest_first, 1)
                rank, left, rest_first, rest = rank + left, 0, rest_first + 1, rest - 1
            put(c - each * length, first, full)
            put(c, rest_first, rest)
            if not room[c]:
                tree.set(c, False)
    return seats, bins


def tokenize_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                    capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``, the token ids
    as little-endian unsigned 32-bit integers) per piece of a document."""
    python_ready(docs.sparkSession)
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda it: trimmed(_pieces(it, tokenizer, capacity, end_id, with_ids)),
                             f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
                             + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents with their seats ``sequence_id, offset``.

    A document's ids and the end id are cut into pieces of ``capacity`` if
    there are more, the first being shorter; pieces are packed into sequences
    of at most ``capacity`` by best-fit decreasing over the whole corpus. The
    packing needs only how many pieces have each length (``capacity`` counts);
    its seats, a few thousand ranges, are joined to the pieces by length and
    rank. Ranks are running counts over (length, bucket) groups.

    A null or empty text is a piece of the end id alone. Repeated rows are
    packed as often as they occur; they are alike, so are their seats but for
    the place. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = materialize(
        tokenize_pieces(docs, id_col, text_col, tokenizer, capacity, end_id, with_ids)
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int")), "pack-pieces")
    cells = materialize(pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    seats, _ = best_fit_decreasing(counts, capacity)
    table = spark.createDataFrame(seats, "length long, first_rank long, count long, first_bin long, per_bin long, at long")
    starts = cells.select("length", "bucket", F.coalesce(
        F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)),
        F.lit(0)).alias("first"))
    ranked = (pieces.join(starts, ["length", "bucket"])
              .withColumn("rank", F.col("first") + F.row_number().over(
                  W.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1))
    place = F.col("rank") - F.col("first_rank")
    return (ranked.join(F.broadcast(table.withColumnRenamed("length", "of")),
                        (F.col("length") == F.col("of")) & (place >= 0) & (place < F.col("count")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("first_bin") + F.floor(place / F.col("per_bin"))).cast("long").alias("sequence_id"),
                    (F.col("at") + place % F.col("per_bin") * F.col("length")).alias("offset"),
                    *(["ids"] if with_ids else [])))
