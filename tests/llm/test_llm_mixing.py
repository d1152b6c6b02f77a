import hashlib
import re
from collections import Counter, defaultdict

import pytest

from llm_data import ODD, docs_table
from veritab.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    """Weighted fair queueing one document at a time."""
    docs = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s in rows]
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    size = Counter()
    for _, s, n in docs:
        size[s] += n
    budget = 1.5 * sum(size.values())
    target, left, free = {}, budget, set(sources)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * size[s] <= weight[s] * level}
        for s in full or free:
            target[s] = 2.0 * size[s] if full else weight[s] * level
            left -= target[s]
        free -= full or set(free)
    copies, total = [], defaultdict(int)
    key = lambda i: "" if i is None else hashlib.md5(str(i).encode()).hexdigest()
    for i, s, n in sorted(docs, key=lambda d: (key(d[0]), d[0] or 0, d[2])):
        total[s] += n
        for e in (0, 1):
            copies.append(((e * size[s] + total[s]) / weight[s], sources.index(s), e, key(i), i or 0, n))
    spent, taken = 0, Counter()
    for c in sorted(copies):
        spent += c[5]
        if spent > budget:
            break
        taken[(c[4], c[5], c[1])] += c[5]
    return size, target, taken


def check(spark, rows):
    size, target, taken = brute(rows)
    out = mixing.mix_sources(docs_table(spark, rows)).collect()
    assert len(out) == len(rows)
    got, words = Counter(), Counter()
    rank = {s: k for k, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    for r in out:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]], abs=1e-6)
        assert r["taken"] <= 2 * r["size"]
        got[(r["doc_id"] or 0, r["size"], rank[r["source"]])] += r["taken"]
        words[r["source"]] += r["taken"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in taken.items() if v}
    return words, target


def test_awkward_rows_and_extra_columns(spark):
    check(spark, ODD)


def test_targets_are_met(spark):
    rows = [(i, "w " * (i % 37 + 1), "en", "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(900)]
    words, target = check(spark, rows)
    assert all(abs(words[s] - target[s]) <= 40 for s in target)


def test_take_mix_repeats_rows(spark):
    docs = docs_table(spark, ODD)
    mixed = mixing.mix_sources(docs).collect()
    taken = mixing.take_mix(docs)
    assert taken.columns == docs.columns
    want = Counter()
    for r in mixed:
        want[(r["doc_id"], r["source"])] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in taken.collect()) == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    assert mixing.mix_sources(docs_table(spark, [])).count() == 0
