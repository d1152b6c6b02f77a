"""Hashed words and word shingles of whole Arrow columns, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are worked on in groups of about so many bytes.
CHUNK_BYTES = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_keys() -> np.ndarray:
    keys = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    keys[65:91] = keys[97:123]  # A-Z as a-z
    return keys


_KEYS = _byte_keys()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), np.uint64(base))
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of UTF-8 texts ``data[offsets[k]:offsets[k + 1]]``,
    A-Z as a-z, and the first word of each text (one more entry at the end).

    A word's hash is its polynomial over the bytes, taken from running sums.
    """
    n = len(data)
    if not n:
        return np.array([], np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # a text's start; the last one is the end
    before = np.r_[False, solid[:-1]] & ~edge[:-1]
    after = np.r_[solid[1:], False] & ~edge[1:]
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_KEYS[data] * _powers(_BASE, n), out=sums[1:])
    words = (sums[ends] - sums[starts]) * _powers(_INVERSE, n)[starts]
    return _mixed(words + (ends - starts).astype(np.uint64)), np.searchsorted(starts, offsets)


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of groups of texts of a string
    column without nulls; a text is never cut."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.array([], np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; of the
    whole sequence if it has fewer words; nothing if it has none."""
    salts = _mixed(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    for _, _, data, offsets in text_groups(column):
        words, first = word_hashes(data, offsets)
        n = len(words)
        windows = np.zeros(max(0, n - k + 1), np.uint64)
        for i in range(k):
            windows += words[i:n - k + 1 + i] * salts[i] if n >= k else windows
        windows = _mixed(windows)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= k:
                yield np.unique(windows[a:b - k + 1])
            elif b > a:
                short = words[a:b] * salts[:b - a]
                yield _mixed(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.array([], np.uint64)
