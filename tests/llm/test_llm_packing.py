import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_data import ODD, docs_table
from veritab.llm import packing


def naive(lengths, capacity):
    """Best-fit decreasing one item at a time."""
    rooms, used = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            used += 1
            bisect.insort(rooms, capacity - n)
        else:
            bisect.insort(rooms, rooms.pop(at) - n)
    return used, sorted(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_ranges_equal_one_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [min(capacity, int(rng.expovariate(3 / capacity)) + 1) for _ in range(rng.randint(1, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    seats, bins = packing.best_fit_decreasing(counts, capacity)
    fill, ranks = [[] for _ in range(bins)], {n: set() for n in counts}
    for length, first, count, first_bin, per_bin, at in seats:
        for r in range(count):
            assert first + r not in ranks[length]
            ranks[length].add(first + r)
            fill[first_bin + r // per_bin].append((at + r % per_bin * length, length))
    assert all(ranks[n] == set(range(counts[n])) for n in counts)
    for b in fill:
        b.sort()
        assert [s for s, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))]
    assert (bins, sorted(capacity - sum(n for _, n in b) for b in fill)) == naive(lengths, capacity)
    assert len(seats) <= 4 * capacity


def test_cached_ids_are_the_tokenizers_own():
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    cached = packing.WordTokenizer.load(packing.TOKENIZER)
    rng = random.Random(1)
    alphabet = [" ", " ", "\n", "\t", " ", " ", "a", "B", "é", "1", "!", "'s", "😀", "the", "\r\n", "\x1c", "\x85", "don't", "'LL", "\u00a0", "Ж", "ß", "中", "²", "½", "_", "\u0301", "I've"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [t or "" for _, t, _, _ in ODD] + [" ", "  ", " a", "a ", "x <|endoftext|> y", "a  b", "a \n b", "\n\nb c"]
    assert cached.plain is not None
    for plain in (cached.plain, None):
        cached.plain = plain
        assert cached.encode(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in own.encode_batch(texts, add_special_tokens=False)]


def test_pieces_and_places(spark):
    own = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = packing.pack_documents(docs_table(spark, ODD)).collect()
    places, pieces = {}, {}
    for r in out:
        assert r["length"] * 4 == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(r["ids"])
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], bytes(r["ids"])))
    for own_places in places.values():
        own_places.sort()
        assert [o for o, _ in own_places] == [sum(n for _, n in own_places[:k]) for k in range(len(own_places))]
        assert sum(n for _, n in own_places) <= 1024
    for i in {i for i, *_ in ODD}:
        texts = [t or "" for k, t, _, _ in ODD if k == i]
        want = np.asarray(own.encode(texts[0], add_special_tokens=False).ids + [2], "<u4").tobytes()
        got = sorted(pieces[i])
        assert b"".join(x for _, _, x in got[::len(texts)]) == want
        assert all(len(x) == 4096 for k, _, x in got if k > 0)
    bound = -(-sum(r["length"] for r in out) // 1024)
    assert len(places) <= bound + 2


def test_empty_table(spark):
    assert packing.pack_documents(docs_table(spark, []), with_ids=False).count() == 0
