"""Passes of mapped features: parts of the rows, and margins that are computed once."""

import numpy as np
from pyspark.sql import functions as F

from veritab.operators import gradient as G


def test_features_are_mapped_for_a_few_rows_at_a_time(monkeypatch):
    rng, n, sizes = np.random.default_rng(5), 3 * G.MAP_ROWS + 17, []
    x = rng.normal(size=(n, 4))
    block = G.Block(x, None, (x[:, 0] > 0).astype(float), rng.integers(0, 3, n).astype("<i4"))
    own_map = G.RandomFourier(0.2, 30)
    nets = [G.Net("hinge", classes=2, feature_map=own_map, without_fold=f) for f in (None, 1)]
    shared = [(net, G.Inputs(np.zeros(4), np.ones(4), own_map), 0.0, 1.0, net.shapes(30), [rng.normal(size=31)]) for net in nets]
    monkeypatch.setattr(G, "MAP_ROWS", n)
    whole = G._evaluate(block, shared)
    monkeypatch.undo()
    plain = G.RandomFourier.__call__
    monkeypatch.setattr(G.RandomFourier, "__call__", lambda self, x: sizes.append(len(x)) or plain(self, x))
    assert np.allclose(G._evaluate(block, shared), whole, rtol=1e-10)
    assert sum(sizes) == n and max(sizes) == G.MAP_ROWS


def test_margins_are_computed_once_for_all_steps(spark, monkeypatch):
    data = spark.range(600).select((F.col("id") % 23 - 11.0).alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                   (F.col("id") % 23 + F.col("id") % 5 > 13).cast("int").alias("y"))
    table = G.pack(data, ["a", "b"], "y", folds=3)
    models = G.fit_nets(table, [G.Net("hinge", classes=2, penalty=1.0, max_iter=20, without_fold=f) for f in range(3)])
    made, plain = [], G._margin_table
    monkeypatch.setattr(G, "_margin_table", lambda *a: made.append(plain(*a)) or made[-1])
    (a, b), = G.fit_platt(table, models)
    assert len(made) == 1 and made[0].features == ["margin 0"]
    margin, hit = [], []
    for block in G._unpacked(iter(table.blocks.toArrow().to_batches()), 2, False):
        for f, model in enumerate(models):
            own = block.rows(block.fold == f)
            margin.append(model.margins(own.x)[:, 0])
            hit.append(own.y == 1)
    m, h = np.concatenate(margin), np.concatenate(hit)
    t = np.where(h, (h.sum() + 1) / (h.sum() + 2), 1 / ((~h).sum() + 2))
    p = 1 / (1 + np.exp(a * m + b))
    assert a < 0 and abs((m * (t - p)).sum()) < 1e-2 and abs((t - p).sum()) < 1e-2  # the gradient is gone
    table.close()
