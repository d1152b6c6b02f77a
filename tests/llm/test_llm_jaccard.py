import random

import pytest

from llm_data import ODD, docs_table
from veritab.llm import jaccard
from veritab.llm.components import connected_components


def shingles(text, k=3):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[i:] for i in range(k)))) if len(words) >= k else frozenset([tuple(words)] if words else [])


def brute(rows, k=3, percent=90):
    """Every pair of documents."""
    sets = [(i, shingles(t, k)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and 100 * both >= percent * (len(x) + len(y) - both):
                a_, b_ = find(i), find(j)
                parent[max(a_, b_)] = min(a_, b_)
    return {i: find(i) for i in parent}


def near_copies(seed, n_texts=6, n_copies=45):
    """Copies with up to a fifth of the words changed, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and a in to".split()) if rng.random() < 0.4 else f"w{rng.randrange(10 ** 6)}"
    shared = [word() for _ in range(60)]
    rows = []
    for k in range(n_texts):
        text = [word() for _ in range(rng.choice([4, 12, 60, 150, 400]))] + (shared if k % 2 else [])
        for _ in range(n_copies):
            own = list(text)
            for _ in range(rng.randrange(max(2, len(own) // 12))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.2:
                own = own[:rng.randrange(len(own)) + 1]
            rows.append((len(rows) * 7 % 1999, " ".join(own), "en", "a"))
    return rows


@pytest.mark.parametrize("k, percent", [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, k, percent):
    rows = near_copies(k)
    out = jaccard.jaccard_components(docs_table(spark, rows), shingle_words=k, percent=percent).collect()
    assert len(out) == len(rows)
    want = brute(rows, k, percent)
    assert {r["doc_id"]: r["component_id"] for r in out} == want
    assert len(set(want.values())) < len(rows) - 60  # there was something to find
    sizes = {i: len(shingles(t, k)) for i, t, *_ in rows}
    assert all(r["n_shingles"] == sizes[r["doc_id"]] for r in out)


def test_awkward_rows(spark):
    out = jaccard.jaccard_components(docs_table(spark, ODD)).collect()
    assert len(out) == len(ODD)
    want = brute(ODD)
    for r in out:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["n_shingles"] == len(shingles(next(t for i, t, *_ in ODD if i == r["doc_id"])))
    assert want[8] == 7 and want[5] == 4 and want[2] == 2


def test_one_of_each_component_stays(spark):
    rows = near_copies(9, 3, 20)
    docs = docs_table(spark, rows)
    out = jaccard.one_per_component(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == set(brute(rows).values())


def test_empty_table(spark):
    assert jaccard.jaccard_components(docs_table(spark, [])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (200, 150), (200, 150)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 131), 100), 150: 150, 200: 150}
