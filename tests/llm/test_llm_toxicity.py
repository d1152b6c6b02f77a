import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from llm_data import ODD, docs_table
from veritab.llm import toxicity as T


def test_machine_learns_an_interaction():
    """Label 1 only if both terms occur: additive weights can't tell."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(600):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.flatnonzero([a, b]))
        y.append(int(a == b))
    model = T.FactorizationMachine.fit(np.array([3, 9]), rows, np.array(y), epochs=600, l2=0.0)

    def score(terms):
        return model.score([np.concatenate([[model.linear[i], (model.factors[i] ** 2).sum()], model.factors[i]]) for i in terms])

    assert score([]) > 0.5 and score([0, 1]) > 0.5 and score([0]) < 0.5 and score([1]) < 0.5


def test_held_out_accuracy_and_contract(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = T.score_toxicity(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] in known]
    recall = np.mean([r["predicted"] for r in held if known[r["doc_id"]] == 1])
    false = np.mean([r["predicted"] for r in held if known[r["doc_id"]] == 0])
    assert recall > 0.85 and false < 0.02


def labels_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, toxic int, text string, score double")


def test_awkward_rows(spark):
    docs = docs_table(spark, ODD)
    labels = labels_table(spark, [(None, 1), (1, None), (4, 3), (4, 1), (5, 0), (5, 0), (99999, 1), (7, 0)])
    out = T.score_toxicity(docs, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    kept = T.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.5 for r in out)


@pytest.mark.parametrize("labels, score", [([], 0.001), ([(i, 1) for i in range(1, 13)], 0.999)])
def test_without_two_classes(spark, labels, score):
    out = T.score_toxicity(docs_table(spark, ODD), labels_table(spark, labels)).collect()
    assert all(r["score"] == pytest.approx(score, rel=1e-3) for r in out)


def test_empty_table(spark):
    assert T.score_toxicity(docs_table(spark, []), labels_table(spark, [(1, 1), (2, 0)])).count() == 0


def test_a_pair_of_harmless_terms_decides(spark):
    """Either term is as frequent with label 1 as without; only both, or neither, is toxic."""
    rng = np.random.default_rng(3)
    fill = ["plain", "words", "stand", "around", "every", "text", "here", "today"]
    docs, labels = [], []
    for i in range(1500):
        a, b = rng.integers(0, 2, 2)
        words = [*rng.choice(fill, 5), *(["group"] if a else []), *(["verb"] if b else [])]
        docs.append((i, " ".join(rng.permutation(words).tolist()), "en", "s"))
        labels.append((i, int(a == b)))
    out = T.score_toxicity(docs_table(spark, docs), labels_table(spark, labels)).collect()
    want = dict(labels)
    held = [r["predicted"] == want[r["doc_id"]] for r in out if r["held_out"]]
    assert np.mean(held) > 0.95 and len({r["score"] for r in out}) > 2


def test_pair_screen_against_brute_force():
    rng = np.random.default_rng(4)
    x = (rng.random((900, 7)) < 0.4).astype(np.uint8)
    y = ((x[:, 1] & x[:, 5]) | (rng.random(900) < 0.2)).astype(int)

    def contrast(i, j):
        value = variance = 0.0
        for p, q, sign in ((1, 1, 1), (1, 0, -1), (0, 1, -1), (0, 0, 1)):
            own = y[(x[:, i] == p) & (x[:, j] == q)]
            hits, rest = own.sum() + 0.5, len(own) - own.sum() + 0.5
            value, variance = value + sign * np.log(hits / rest), variance + 1 / hits + 1 / rest
        return abs(value) / variance ** 0.5

    want = sorted({k for i in range(7) for j in range(7) if i != j and contrast(i, j) >= 4 for k in (i, j)})
    assert T.interacting_terms(x, y, 4.0).tolist() == want == [1, 5]


def test_scores_against_brute_force():
    rng = np.random.default_rng(5)
    terms = np.sort(rng.choice(1 << T.HASH_BITS, 40, replace=False)).astype(np.int32)
    words = ["alpha", "beta", "gammas", "epsilon", "zetas"]
    terms = np.unique(np.concatenate([terms, [T.word_terms(w)[0] for w in words], T.word_terms("epsilon")])).astype(np.int32)
    m = T.FactorizationMachine(terms, 0.3, rng.normal(size=len(terms)), rng.normal(size=(len(terms), 3)))
    for text in ("Alpha beta, epsilon; ALPHA", "zetas", "", "other"):
        found = [int(np.searchsorted(terms, t)) for w in sorted(T.text_words(text)) for t in T.word_terms(w) if t in terms]
        z = m.bias + sum(m.linear[i] for i in found)
        z += sum(m.factors[i] @ m.factors[j] for k, i in enumerate(found) for j in found[k + 1:])
        shares = [s for w in sorted(T.text_words(text)) if (s := m.word_share(w)) is not None]
        assert m.score(shares) == pytest.approx(1 / (1 + np.exp(-z)))


def test_rows_that_repeat_a_labelled_id(spark):
    docs = docs_table(spark, [(1, "bad word", "en", "s")] * 300 + [(i, "good word", "en", "s") for i in range(2, 40)])
    labels = labels_table(spark, [(1, 1)] + [(i, 0) for i in range(2, 40)])
    model = T.fit_toxicity(docs.select("doc_id", "text"), labels.select("doc_id", F.col("toxic").alias("label")))
    assert model.bias == model.bias and T.score_toxicity(docs, labels).count() == 338
