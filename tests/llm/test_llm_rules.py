import re
from collections import Counter

import numpy as np

from conftest import SF_SMALL
from llm_data import ODD, docs_table
from veritab.llm import quality_rules as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {j for i, w in enumerate(windows) if seen[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def test_counts_match_brute_force(spark):
    rows = ODD + [(20, "a b c a b c a b c x", "en", "a"), (21, "q q q q", "en", "a"), (22, "l 1\nl 1 \nl 1\n\n#*$", "en", "a"),
                  (23, " ".join(f"u{i}" for i in range(60)) + " u1 u2 u3", "en", "a"), (24, "a b\n a b\na b", "en", "a")]
    labels = spark.createDataFrame([(23, 1, "k"), (None, 1, "k")], "doc_id long, quality int, words string")
    out = R.score_rules(docs_table(spark, rows), labels).collect()
    assert len(out) == len(rows)
    for r in out:
        want = next(brute(t) for i, t, *_ in rows if i == r["doc_id"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want
        assert not (r["kept"] and r["base_failed"])


def test_verdict_on_labels(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = R.score_rules(docs, labels).collect()
    assert len(out) == docs.count()
    assert np.mean([r["kept"] for r in out if known.get(r["doc_id"]) == 1 and not r["base_failed"]]) > 0.98
    assert np.mean([r["kept"] for r in out if known.get(r["doc_id"]) == 0]) < 0.1


def test_no_trusted_documents_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = R.score_rules(docs_table(spark, ODD), none).collect()
    assert all(r["kept"] != r["base_failed"] for r in out)
    assert R.score_rules(docs_table(spark, []), none).count() == 0
