import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from llm_data import ODD, docs_table
from veritab.llm import sentence_pieces as sp

RULES = ["identity", "nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"]
ALPHABET = [" ", " ", "  ", "a", "B", "é", "ﬁ", "Ａ", "①", "㌔", "ｶﾞ", "é", "́", "\t", "\n", "​", " ", "▁", "x", "😀", "한", "\x01", "Ⅷ", "ß"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sp.MODEL))


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("flags", [(True, True, True), (False, False, True), (True, False, False), (False, True, True)])
def test_normaliser_equals_the_librarys(rule, flags):
    dummy, squeeze, escape = flags
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=dummy, escape_whitespaces=escape,
                                                   remove_extra_whitespaces=squeeze)
    own = sp.Normalizer.of_model(theirs.serialized_model_proto())
    own.dummy_prefix, own.squeeze, own.escape = flags
    rng = random.Random(4)
    for text in ["", " ", "   ", "a", " a ", *("".join(rng.choices(ALPHABET, k=rng.randint(1, 25))) for _ in range(400))]:
        want, places = theirs.normalize(text, with_offsets=True)
        normal, place = own(text.encode())
        assert normal.decode() == want, text
        if not want:  # nothing is left to have a place
            continue
        # the library counts characters of the text, one entry for each of the result and its end
        starts = np.concatenate([[0], np.cumsum([len(c.encode()) for c in want])]).astype(int)
        chars = [len(text.encode()[:p].decode(errors="strict")) for p in place[starts]]
        # ours puts the dummy mark right in front of what follows it
        assert chars[dummy:] == list(places)[dummy:] and chars[0] in (places[0], chars[1]), text


def texts():
    rng = random.Random(9)
    return [(t or "") for _, t, _, _ in ODD] + ["".join(rng.choices([*ALPHABET, "the ", "of", "<s>", "\0", "1"], k=rng.randint(0, 60)))
                                               for _ in range(500)]


def test_spans_tile_the_text(library):
    codec = sp.PieceCodec.load(sp.MODEL)
    for text in texts():
        raw = text.encode()
        ids = codec.encode([raw])[0]
        assert ids.tolist() == library.encode(text)
        starts, ends = codec.spans(raw, ids)
        assert (starts[1:] == ends[:-1]).all()
        assert (not raw and not len(ids)) or (starts[0] == 0 and ends[-1] == len(raw))
        for i, a, b in zip(ids.tolist(), starts, ends):
            piece = library.id_to_piece(i)
            spelled = bytes([int(piece[3:5], 16)]) if library.is_byte(i) else piece.replace(sp.SPACE, " ").encode()
            own = raw[a:b].replace(sp.SPACE.encode(), b" ")
            assert own == spelled or (a == 0 and b" " + own == spelled)


def test_windows_change_nothing(library):
    codec = sp.PieceCodec.load(sp.MODEL)
    for text in texts():
        raw = text.encode()
        for size in (1, 7, 40):
            flat = [i for w in codec.windows(raw, size) for i in library.encode(w)]
            assert flat == library.encode(text), (text, size)
    assert len(codec.windows(b"word " * 50, 7)) > 20


def test_bytes_that_are_no_text(library):
    codec = sp.PieceCodec.load(sp.MODEL)
    for raw in (b"abc\xff\xfe def", b"\xe2\x82", b"\xc3 \xa9", "é".encode() + b"\x80"):
        ids = codec.encode([raw])[0]
        assert ids.tolist() == library.encode(raw)
        starts, ends = codec.spans(raw, ids)
        assert ends[-1] == len(raw)


def test_query_columns(spark, library):
    out = sp.piece_digest(sp.encode_texts(docs_table(spark, ODD), with_decoded=True)).collect()
    want = []
    for i, t, _, _ in ODD:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)


def test_round_trip_and_odd_ids(spark, library):
    docs = docs_table(spark, ODD)
    back = sp.decode_ids(sp.encode_texts(docs, with_spans=False)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, back), key=key) == sorted(((i, library.decode(library.encode(t or ""))) for i, t, _, _ in ODD), key=key)
    odd = spark.createDataFrame([(1, None), (2, []), (3, [None, -5, 10**6, 801])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in sp.decode_ids(odd).collect()} == {1: "", 2: "", 3: library.decode([801])}
    assert sp.encode_texts(docs_table(spark, [])).count() == 0
