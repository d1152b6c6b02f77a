import hashlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from llm_data import ODD, docs_table
from veritab.llm import dedup
from veritab.llm.dedup import CountingQuotientFilter


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_marks_match_brute_force(spark):
    rows = ODD + [(100 + i, "Copy of THE text" if i % 2 else f"own {i}", "en", "a") for i in range(40)]
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(lower(t), []).append(i)
    out = dedup.mark_duplicates(docs_table(spark, rows)).collect()
    want = Counter()
    for i, t, _, _ in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want[(i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest())] += 1
    assert Counter(tuple(r) for r in out) == want


def test_removal_leaves_one_row_of_each_text(spark):
    docs = docs_table(spark, ODD)
    out = dedup.drop_duplicates_exact(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sorted(lower(r["text"]) for r in rows) == sorted({lower(t) for _, t, _, _ in ODD})
    assert {r["doc_id"] for r in rows} >= {3, 5, 6, 8, 9, 10}


def test_empty_table(spark):
    assert dedup.mark_duplicates(docs_table(spark, [])).count() == 0
    assert dedup.drop_duplicates_exact(docs_table(spark, [])).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 3), max_size=30), min_size=1, max_size=4),
       st.sampled_from([1, 5, 12]))
def test_filters_merge_without_loss(parts, bits):
    merged = CountingQuotientFilter({}, bits)
    for p in parts:
        merged = merged.merge(CountingQuotientFilter.build(np.array(p, np.uint64), bits))
    assert dict(merged.items()) == Counter(x for p in parts for x in p)
