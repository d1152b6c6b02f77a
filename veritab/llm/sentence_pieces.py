"""Operator 12: SentencePiece ids with the source bytes of every piece, and back."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, col, python_ready

MODEL = "piece_bpe_32k.model"
#: Bytes of text that a worker encodes at once. A longer text is encoded in
#: windows where the vocabulary allows it, so memory does not grow with it.
SLICE_BYTES = 1 << 20
SPACE = "▁"
REPLACEMENT = "�".encode()


# The model's own description: protobuf fields, then the compiled character map.

def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at:at + size], at + size
        yield key >> 3, value


def character_map(compiled: bytes) -> dict[str, str]:
    """Source to target strings of a compiled character map: four bytes with
    the size of a double-array trie, its 32-bit units, and the targets, each
    ended by a zero byte, which the trie's leaves point at."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled[4:4 + size], "<u4").astype(np.int64)
    targets = compiled[4 + size:]
    base = (units >> 10) << ((units & 512) >> 6)
    labels, found = np.arange(256), {}
    todo = [(b"", int(base[0]))]
    while todo:
        key, place = todo.pop()
        at = place ^ labels
        inside = at < len(units)
        at = np.where(inside, at, 0)
        for c in np.flatnonzero(inside & ((units[at] & 0x800000FF) == labels) & (labels > 0)).tolist():
            node = place ^ c
            longer, below = key + bytes([c]), node ^ int(base[node])
            if units[node] & 256:
                start = int(units[below] & 0x7FFFFFFF)
                found[longer] = targets[start:targets.index(b"\0", start)]
            todo.append((longer, below))
    return {k.decode(): v.decode() for k, v in found.items()}


class Normalizer:
    """Longest-prefix normalisation that keeps, for every normalised byte, the
    place of its source byte."""

    def __init__(self, mapping: dict[str, str], kept: list[str] = (), dummy_prefix: bool = True,
                 squeeze: bool = True, escape: bool = True, space_last: bool = False):
        self.mapping, self.kept = mapping, set(kept)
        self.dummy_prefix, self.squeeze, self.escape, self.space_last = dummy_prefix, squeeze, escape, space_last
        self.longest: dict[str, int] = {}
        for key in (*mapping, *self.kept):
            self.longest[key[0]] = max(self.longest.get(key[0], 0), len(key))
        self.start = re.compile("[" + "".join(map(re.escape, self.longest)) + "]") if self.longest else None

    @classmethod
    def of_model(cls, serialized: bytes, kept: list[str] = ()) -> Normalizer:
        for number, value in message_fields(serialized):
            if number == 3:  # the normaliser's own message
                spec = dict(message_fields(value))
                break
        else:
            spec = {}
        suffix = any(number == 2 and dict(message_fields(value)).get(24, 0) for number, value in message_fields(serialized))
        return cls(character_map(spec.get(2, b"")), kept, bool(spec.get(3, 1)), bool(spec.get(4, 1)),
                   bool(spec.get(5, 1)), suffix)

    @property
    def identity(self) -> bool:
        return self.start is None and not self.squeeze

    def _match(self, text: str, at: int) -> tuple[str, str] | None:
        lengths = range(self.longest[text[at]], 0, -1)
        for own in (self.kept, self.mapping):
            for n in lengths:
                key = text[at:at + n]
                if key in own:
                    return key, key if own is self.kept else self.mapping[key]
        return None

    def _mapped(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes behind the character map, and the source place of each."""
        try:
            decoded = text.decode()
        except UnicodeDecodeError:
            return self._repaired(text)
        if self.start is None:
            return np.frombuffer(text, np.uint8), np.arange(len(text))
        out, places, at, byte = [], [], 0, 0

        def copy(to: int) -> int:
            raw = decoded[at:to].encode()
            out.append(raw)
            places.append(np.arange(byte, byte + len(raw)))
            return byte + len(raw)

        while (hit := self.start.search(decoded, at)) is not None:
            found = self._match(decoded, hit.start())
            byte = copy(hit.start() if found else hit.end())
            at = hit.start() if found else hit.end()
            if found:
                source, target = found
                raw = target.encode()
                out.append(raw)
                # a kept string stands for itself, a target for the start of its source
                places.append(byte + np.arange(len(raw)) if source in self.kept else np.full(len(raw), byte))
                at, byte = at + len(source), byte + len(source.encode())
        copy(len(decoded))
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate(places)

    def _repaired(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As ``_mapped`` for bytes that are not UTF-8: each bad byte is one
        replacement character."""
        out, places, at = [], [], 0
        while at < len(text):
            try:
                good, bad = text[at:], 0
                good.decode()
            except UnicodeDecodeError as e:
                good, bad = text[at:at + e.start], 1
            if good:
                own, place = self._mapped(good)
                out.append(own)
                places.append(at + place)
            at += len(good)
            if bad:
                out.append(np.frombuffer(REPLACEMENT, np.uint8))
                places.append(np.full(3, at))
                at += 1
        return np.concatenate(out), np.concatenate(places)

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes and, for each and for their end, the source
        place it comes from."""
        if not text:
            return b"", np.zeros(1, np.int64)
        data, place = self._mapped(text)
        last = len(text)
        if self.squeeze:
            blank = data == 32
            keep = ~(blank & np.concatenate([[True], blank[:-1]]))
            data, place = data[keep], place[keep]
            if not len(data):
                return b"", np.full(1, last, np.int64)
        mark = np.frombuffer((SPACE if self.escape else " ").encode(), np.uint8)
        if self.escape:
            blank = data == 32
            size = np.where(blank, 3, 1)
            ends = np.cumsum(size)
            data, place = np.repeat(data, size), np.repeat(place, size)
            for k, byte in enumerate(mark):
                data[ends[blank] - 3 + k] = byte
        if self.dummy_prefix and not self.space_last:
            at = int(place[0]) if len(place) else last
            data, place = np.concatenate([mark, data]), np.concatenate([np.full(len(mark), at), place])
        if self.squeeze:
            raw = data.tobytes()
            while raw.endswith(mark.tobytes()):
                raw = raw[:-len(mark)]
                last = int(place[len(raw)])
            data, place = data[:len(raw)], place[:len(raw)]
        if self.dummy_prefix and self.space_last:
            data, place = np.concatenate([data, mark]), np.concatenate([place, np.full(len(mark), last)])
        return data.tobytes(), np.append(place, last)


class PieceCodec:
    """Encoder of whole texts with the source span of every piece."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        serialized = model.serialized_model_proto()
        kept = [dict(message_fields(v))[1].decode() for number, v in message_fields(serialized)
                if number == 1 and dict(message_fields(v)).get(3) == 4]
        self.sizes = np.array([1 if model.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int64)
        self.unknown = model.unk_id()
        self.normalize = Normalizer.of_model(serialized, kept)
        # no piece goes on behind a space mark that follows something else, so a text may be cut in front of it
        self.cuttable = (self.normalize.identity and not kept and self.normalize.dummy_prefix and self.normalize.escape
                         and not self.normalize.space_last
                         and not any(SPACE in p.lstrip(SPACE) for p in pieces))

    @classmethod
    def load(cls, name: str) -> PieceCodec:
        if not os.path.isabs(name):
            import public_tokenizers
            name = public_tokenizers.path(name)
        return cls(name)

    def windows(self, text: bytes, size: int = SLICE_BYTES) -> list[bytes]:
        """A long text cut at single blanks between words; the blank goes, as
        the model puts a space mark in front of every text."""
        out, at = [], 0
        while self.cuttable and len(text) - at > size:
            cut = at + size
            while (cut := text.find(b" ", cut)) >= 0 and (
                    text[cut - 1:cut] == b" " or text[cut - 3:cut] == SPACE.encode() or cut + 1 == len(text)):
                cut += 1
            if cut < 0:
                break
            out.append(text[at:cut])
            at = cut + 1
        return [*out, text[at:]]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        parts = [self.windows(t) for t in texts]
        flat = iter(self.model.encode([w for p in parts for w in p], num_threads=1))
        return [np.concatenate([np.asarray(next(flat), np.int64) for _ in p]) for p in parts]

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) in the text's bytes of the pieces ``ids``."""
        normal, place = self.normalize(text)
        sizes = self.sizes[ids]
        if (ids == self.unknown).any():  # an unknown piece is as long as what it stands for
            sizes = np.array([len(p.encode()) if i == self.unknown else self.sizes[i]
                              for i, p in zip(ids.tolist(), self.model.encode(text, out_type=str))], np.int64)
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return place[ends - sizes], place[ends]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.model.decode([i.tolist() for i in ids], num_threads=1) if ids else []


_LOADED: dict[str, PieceCodec] = {}


def _codec(name: str) -> PieceCodec:
    if name not in _LOADED:
        _LOADED[name] = PieceCodec.load(name)
    return _LOADED[name]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], name: str, with_spans: bool, with_decoded: bool) -> Iterator[pa.RecordBatch]:
    codec = _codec(name)
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text").cast(pa.binary())
        sizes = pc.binary_length(text).to_numpy(zero_copy_only=False)
        for start, end in byte_slices(sizes, SLICE_BYTES):
            own = text.slice(start, end - start).to_pylist()
            ids = codec.encode(own)
            arrays, names = [batch.column("doc_id").slice(start, end - start), _lists(ids)], ["doc_id", "ids"]
            if with_spans:
                starts, ends = zip(*map(codec.spans, own, ids))
                arrays, names = [*arrays, _lists(starts), _lists(ends)], [*names, "starts", "ends"]
            if with_decoded:
                arrays, names = [*arrays, pa.array(codec.decode(ids), pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL,
                 with_spans: bool = True, with_decoded: bool = False) -> DataFrame:
    """``doc_id, ids, starts, ends`` (and ``decoded``) of every whole text.

    ``ids`` are those of the library for this model, without begin or end ids.
    ``starts`` and ``ends`` are places in the text's UTF-8 bytes: longest-prefix
    normalisation through the model's compiled character map records where each
    normalised byte comes from, and the pieces, which tile the normalised text,
    are projected back. The spans tile the text, but for blanks that the model
    strips at its ends; a dummy space mark has no width, byte pieces of
    one character share its bytes. ``decoded`` is the library's text of ``ids``.

    A null or empty text has no ids. Repeated rows are encoded as often as
    they occur, an empty table gives no rows, other columns are not read. Rows
    are encoded in slices of ``SLICE_BYTES``, a longer text in windows; nothing
    is shuffled.
    """
    python_ready(docs.sparkSession)
    source = docs.select(col(id_col).alias("doc_id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        lambda it: _encoded(it, model, with_spans, with_decoded), f"doc_id {kind}, ids array<int>"
        + ", starts array<int>, ends array<int>" * with_spans + ", decoded string" * with_decoded)


def _decoded(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    codec = _codec(name)
    for batch in batches:
        lists = batch.column("ids")
        for start in range(0, batch.num_rows, 256):
            own = [np.array([i for i in x or [] if i is not None and 0 <= i < len(codec.sizes)], np.int64)
                   for x in lists.slice(start, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, 256), pa.array(codec.decode(own), pa.string())],
                                             names=["doc_id", "text"])


def decode_ids(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of every row's ids. Null ids and ids outside the
    vocabulary stand for nothing; a null or empty list is an empty text."""
    python_ready(encoded.sparkSession)
    source = encoded.select(col(id_col).alias("doc_id"), col(ids_col).cast("array<int>").alias("ids"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(lambda it: _decoded(it, model), f"doc_id {kind}, text string")


def piece_digest(encoded: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes`` of
    encoded texts; the last is where the last piece ends in the source."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("covered_bytes"))
