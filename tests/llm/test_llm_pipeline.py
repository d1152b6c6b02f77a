from collections import Counter

import pytest

import corpus_pipeline as P
from conftest import SF_SMALL
from test_llm_jaccard import brute, shingles
from veritab.llm import toxicity
from veritab.llm.common import materialize


@pytest.fixture(scope="module")
def steps(spark):
    """The documents and every stage's result."""
    docs = spark.read.parquet(SF_SMALL + "/documents.parquet")
    out = [docs]
    for _, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_SMALL), "test"))
    return out


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_every_stage_decides_as_its_operator(spark, steps):
    docs, clean, single, apart, mixed, packed = steps
    assert all(s.columns == docs.columns for s in (clean, single, apart, mixed))
    labels = spark.read.parquet(SF_SMALL + "/labels.parquet")
    harmless = {r["doc_id"] for r in toxicity.score_toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in clean.collect()} == harmless and clean.count() == len(harmless)
    last = {}
    for r in clean.collect():
        last[lower(r["text"])] = max(last.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(last.values())
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(set(brute(rows, 5, 80).values()))
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert set(copies) <= {r["doc_id"] for r in apart.collect()} and set(copies.values()) <= {1, 2}
    words = lambda df: sum(len((r["text"] or "").encode().split()) for r in df.collect())
    assert words(mixed) <= 1.5 * words(apart) and words(mixed) > 1.3 * words(apart)
    firsts = Counter(r["doc_id"] for r in packed.where("piece = 0").collect())
    assert firsts == copies


def test_run_gives_the_last_stage(spark, steps):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: Counter(tuple(r) for r in df.select(key).collect())
    assert rows(P.run(spark, SF_SMALL)) == rows(steps[-1])
    assert shingles("a b") == frozenset([(b"a", b"b")])
