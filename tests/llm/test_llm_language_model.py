from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF_SMALL
from llm_data import ODD, docs_table
from veritab.llm import language_model as L

TEXTS = ["the cat sat on the mat", "the dog sat", "a cat and a dog and a bird", "the the the", "é ü"]


class Brute:
    """Interpolated modified Kneser-Ney by its definition."""

    def __init__(self, texts, order=L.ORDER):
        self.order = order
        grams = Counter()
        for t in texts:
            b = b"\0" * (order - 1) + t.encode()
            grams.update(b[i - order + 1:i + 1] for i in range(order - 1, len(b)))
        self.counts = {order: grams}
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts = {}
        for k, c in self.counts.items():
            n = [max(1, sum(v == i for v in c.values())) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            self.discounts[k] = [min(i + 1, max(0.05, i + 1 - (i + 2) * y * n[i + 1] / n[i])) for i in range(3)]
        self.by = {k: defaultdict(list) for k in self.counts}
        for k, c in self.counts.items():
            for g, v in c.items():
                self.by[k][g[:-1]].append(v)

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        d = lambda v: self.discounts[k][min(v, 3) - 1]
        own, lower = self.by[k].get(gram[:-1]), self.p(gram[1:])
        if not own:
            return lower
        v = self.counts[k].get(gram, 0)
        return ((v - d(v)) if v else 0) / sum(own) + sum(map(d, own)) / sum(own) * lower


def test_probabilities_match_the_definition(spark):
    model = L.fit_kneser_ney(spark.createDataFrame([(t,) for t in TEXTS], "text string"))
    brute = Brute(TEXTS)
    some = ["the cat", "zebra!", "a", "é", "dog and the mat sat"]
    got = list(L.text_log_probs(pa.array(some), *model.tables()))
    for text, (total, n) in zip(some, got):
        b = b"\0" * (L.ORDER - 1) + text.encode()
        want = sum(np.log(brute.p(b[i:i + L.ORDER])) for i in range(len(text.encode())))
        assert n == len(text.encode()) and total == pytest.approx(want, rel=1e-4)


def test_blocks_find_what_the_whole_model_has(spark):
    rng = np.random.default_rng(3)  # random bytes: far more contexts than 65,536
    texts = ["".join(map(chr, rng.integers(32, 1000, 3000))) for _ in range(60)] + TEXTS + [""]
    source = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, lang string, trusted boolean")
    model = L.fit_kneser_ney(source.select("text").limit(50))
    keys = model.tables()[0]
    assert np.all(keys[1:] > keys[:-1]) and np.sum(keys >> np.uint64(L.LEVEL) == L.ORDER - 1) > 1 << 16
    want = [-s / n if n else float("nan") for s, n in L.text_log_probs(pa.array(texts), *model.tables())]
    got = {r["doc_id"]: r["log_perplexity"] for r in L.score_texts(source, model).collect()}
    assert len(got) == len(texts) and got[len(texts) - 1] is None
    assert [got[i] for i in range(len(texts) - 1)] == pytest.approx(want[:-1], rel=1e-5)


def test_shuffled_words_are_not_trusted_text(spark):
    sf = SF_SMALL.replace("0.001", "0.1")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.where("quality = 1 and doc_id % 2 = 0").select("doc_id"), "doc_id").select("doc_id", "text", "lang").limit(300).collect()
    mixed = [(-1 - i, " ".join(np.random.default_rng(i).permutation(r["text"].split(" "))), r["lang"]) for i, r in enumerate(good)]
    every = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    out = L.score_quality(every, labels.where("doc_id % 2 = 1")).where("doc_id < 0").collect()
    assert np.mean([r["kept"] for r in out]) < 0.4


def test_separates_quality_on_labels(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    out = L.score_quality(docs, labels).collect()
    assert len(out) == docs.count()
    assert np.mean([r["kept"] for r in out if known.get(r["doc_id"]) == 1]) > 0.99
    assert np.mean([r["kept"] for r in out if known.get(r["doc_id"]) == 0]) < 0.15


def test_awkward_rows_and_no_trusted_text(spark):
    docs = docs_table(spark, ODD)
    for rows in ([], [(4, 1), (4, 0), (None, 1), (77, 1), (7, 1), (7, None)]):
        labels = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, quality int, lang string")
        out = L.score_quality(docs, labels).collect()
        assert len(out) == len(ODD)
        for r in out:
            if not next(t for i, t, *_ in ODD if i == r["doc_id"]):
                assert r["perplexity"] is None and not r["kept"]
            elif not rows:
                assert r["kept"] and r["perplexity"] == pytest.approx(256)
        assert next(r for r in out if r["doc_id"] == 9)["threshold"] is None


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert L.score_quality(docs_table(spark, []), labels).count() == 0
