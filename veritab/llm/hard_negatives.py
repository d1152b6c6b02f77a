"""Operator 13: hard negatives by score windows, with bounds along a spanning tree of the anchors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, materialize, python_ready

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of its positive's.
LOW, HIGH = 50, 95
#: Anchors of a spanning tree, candidates that a task scores at once.
TREE, BLOCK = 512, 2048
#: Bytes of anchors that are sent to the executors at once; more anchors take
#: more rounds over the candidates.
ROUND_BYTES = 32 << 20
#: Entries beyond this have no long of their own and count as not finite.
LARGEST = float(1 << 62)
LONG = np.iinfo(np.int64)


def clean_rows(vectors: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str | Column) -> DataFrame:
    """``vec_id, label, v, anchor`` of the rows that take part."""
    v = col(vector_col).cast("array<double>")
    label = col(label_col) if isinstance(label_col, str) else label_col
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE >= LARGEST))
    return (vectors.select(col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"),
                           F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad))


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, labels, scaled vectors) of the rows of each dimension, ``size``
    at a time; scaled entries are whole numbers held as doubles."""
    for batch in batches:
        lists = batch.column("v")
        ids, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            for at in range(0, len(rows), size):
                own = rows[at:at + size]
                x = lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)
                yield ids[own], labels[own], np.floor(SCALE * x)


def inner(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact integer inner products of whole rows; one that no long holds
    counts as the nearest long."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    if np.abs(x).max() * np.abs(a).max() * len(a) < 2.0 ** 53:
        return (x @ a).astype(np.int64)
    own = [int(v) for v in a]
    return np.array([min(max(sum(int(v) * w for v, w in zip(r, own)), LONG.min), LONG.max) for r in x.tolist()], np.int64)


def first_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the first ``k``: higher scores first, ties by smaller id."""
    if len(scores) > 64 * k:  # the rest can't be among them
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -1 - scores[near]))[:k]]
    return np.lexsort((ids, -1 - scores))[:k]  # -1 - s falls as s rises, and fits also for the smallest long


@dataclass
class Tree:
    """Anchors of one dimension in an order in which parents come first."""

    ids: np.ndarray
    labels: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    x: np.ndarray

    @classmethod
    def spanning(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Tree:
        """The minimum spanning tree by distance, from the anchor with the
        smallest sum of distances on."""
        n = len(ids)
        norms = (x * x).sum(axis=1)
        near = np.sqrt(np.maximum(norms[:, None] + norms[None, :] - 2 * (x @ x.T), 0))
        root = int(near.sum(axis=1).argmin())
        best, link, outside = near[root].copy(), np.full(n, root), np.ones(n, bool)
        order, place, parent = [root], np.zeros(n, int), [-1]
        outside[root] = False
        while len(order) < n:
            k = int(np.where(outside, best, np.inf).argmin())
            place[k], outside[k] = len(order), False
            order.append(k)
            parent.append(int(place[link[k]]))
            closer = outside & (near[k] < best)
            best[closer], link[closer] = near[k][closer], k
        x = x[order]
        edge = np.linalg.norm(x - x[parent], axis=1)
        return cls(ids[order], labels[order], np.array(parent), edge, x)

    def pack(self) -> list[bytes]:
        return [a.astype(t).tobytes() for a, t in ((self.ids, "<i8"), (self.labels, "<i8"), (self.parent, "<i8"),
                                                   (self.edge, "<f8"), (self.x, "<f8"))]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Tree:
        ids, labels, parent, edge, x = (np.frombuffer(p, t) for p, t in zip(parts, ("<i8", "<i8", "<i8", "<f8", "<f8")))
        return cls(ids, labels, parent, edge, x.reshape(len(ids), -1))

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(anchor, low, high, known) in order: bounds of its scores with the
        rows of ``x``. The caller sets ``known`` places of low and high to exact
        scores, and children's bounds follow from that: a child's score differs
        by the edge's length times the row's norm at most."""
        norms = np.linalg.norm(x, axis=1)
        own = np.linalg.norm(self.x, axis=1)
        low, high = np.empty((len(self.ids), len(x))), np.empty((len(self.ids), len(x)))
        for k, p in enumerate(self.parent):
            if p < 0:
                low[k] = high[k] = inner(x, self.x[k])
            else:
                # the small terms are for rounding
                reach = (self.edge[k] * (1 + 1e-9) + 1e-12 * own[p]) * norms + 1
                np.subtract(low[p], reach, out=low[k])
                np.add(high[p], reach, out=high[k])
            yield k, low[k], high[k]


def _rescore(x: np.ndarray, a: np.ndarray, low: np.ndarray, high: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, exact scores) where ``need``; the bounds close there."""
    at = np.flatnonzero(need)
    scores = inner(x[at], a)
    low[at] = high[at] = scores
    return at, scores


class Best:
    """The first ``k`` (score, id) met so far."""

    def __init__(self, k: int, floor: int = LONG.min):
        self.k, self.floor = k, floor  # scores under the floor are not among the first k of all rows
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        return max(self.floor, int(self.scores[-1])) if len(self.scores) == self.k else self.floor

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = first_rows(scores, ids, self.k)
            self.scores, self.ids = scores[first], ids[first]


def window(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The least and the largest whole score between ``low`` and ``high``
    hundredths of ``score``."""
    return -(-low * score // 100), high * score // 100


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid
    for ids, labels, x in _blocks(batches, TREE):
        tree = Tree.spanning(ids, labels, x)
        packed = tree.pack()
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), pa.array([sum(map(len, packed))], pa.int64()), pa.array([packed], pa.list_(pa.binary()))],
            names=["tree", "bytes", "packed"])


def _positive_parts(batches: Iterator[pa.RecordBatch], trees, k: int) -> Iterator[pa.RecordBatch]:
    state = []
    for name, packed in trees:
        tree = Tree.unpack(packed)
        best = []
        for a in range(len(tree.ids)):  # the tree's own anchors are rows too: a floor for the others
            mates = np.flatnonzero((tree.labels == tree.labels[a]) & (tree.ids != tree.ids[a]))
            scores = np.sort(inner(tree.x[mates], tree.x[a]))
            best.append(Best(k, int(scores[-k]) if len(scores) >= k else LONG.min))
        state.append((name, tree, best))
    for ids, labels, x in _blocks(batches, BLOCK):
        for _, tree, best in state:
            if tree.x.shape[1] == x.shape[1]:
                for a, low, high in tree.walk(x):
                    need = (labels == tree.labels[a]) & (ids != tree.ids[a]) & (high >= best[a].least)
                    at, scores = _rescore(x, tree.x[a], low, high, need)
                    best[a].add(scores, ids[at])
    for name, tree, best in state:
        size = [len(b.ids) for b in best]
        if sum(size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * sum(size)), pa.array(np.repeat(np.arange(len(size)), size), pa.int32()),
                 pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))],
                names=["tree", "slot", "id", "score"])


def _negative_parts(batches: Iterator[pa.RecordBatch], trees, k: int, low_share: int, high_share: int) -> Iterator[pa.RecordBatch]:
    """trees: (name, packed, positives), the last a list of (id, score) per anchor."""
    state = []
    for name, packed, positives in trees:
        tree = Tree.unpack(packed)
        # one search a different score: equal scores have equal windows
        seeks = [{s: (*window(s, low_share, high_share), Best(k)) for _, s in own} for own in positives]
        seeks = [{s: w for s, w in own.items() if w[0] <= w[1]} for own in seeks]
        state.append((name, tree, positives, seeks))
    for ids, labels, x in _blocks(batches, BLOCK):
        for _, tree, _, seeks in state:
            if tree.x.shape[1] != x.shape[1]:
                continue
            for a, low, high in tree.walk(x):
                if not seeks[a]:
                    continue
                need = np.zeros(len(ids), bool)
                for first, last, best in seeks[a].values():
                    need |= (low <= last) & (high >= max(first, best.least))
                at, scores = _rescore(x, tree.x[a], low, high, need & (labels != tree.labels[a]) & (ids != tree.ids[a]))
                for first, last, best in seeks[a].values():
                    inside = (scores >= max(first, best.least)) & (scores <= last)
                    best.add(scores[inside], ids[at[inside]])
    for name, tree, positives, seeks in state:
        rows = [(name, a, p, int(tree.ids[a]), positive, ps, int(i), int(s))
                for a, own in enumerate(positives) for p, (positive, ps) in enumerate(own) if ps in seeks[a]
                for i, s in zip(seeks[a][ps][2].ids, seeks[a][ps][2].scores)]
        if rows:
            columns = list(zip(*rows))
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["tree", "slot", "p", "anchor_id", "positive_id", "positive_score",
                                                    "negative_id", "negative_score"])


def anchor_trees(clean: DataFrame) -> DataFrame:
    """``tree, bytes, packed``: a row per spanning tree of at most ``TREE``
    anchors. Anchors are dealt by ranges of (dimension, label, id), so that
    those of a tree are alike and no label is one task."""
    dealt = clean.where("anchor").repartitionByRange(F.size("v"), "label", "vec_id")
    return materialize(dealt.mapInArrow(_trees, "tree string, bytes long, packed array<binary>"), "negatives-trees")


def round_filters(trees: DataFrame, round_bytes: int) -> list[Column]:
    """Conditions that split the trees into rounds of at most ``round_bytes``
    (or one tree)."""
    total, largest = trees.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    rounds = max(1, -(-total // round_bytes)) if total else 0
    while rounds:
        number = F.pmod(F.xxhash64("tree"), F.lit(rounds))
        if rounds == 1 or trees.groupBy(number).agg(F.sum("bytes").alias("b")).agg(F.max("b")).first()[0] <= max(round_bytes, largest):
            break
        rounds = rounds + max(1, rounds // 4)
    return [number == k for k in range(rounds)]


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                        label_col: str | Column = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
                        low: int = LOW, high: int = HIGH, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` for the rows where ``is_anchor`` holds, against all rows.

    Scores are exact inner products of the entries floor(256 x). An anchor's
    positives are its first ``positives`` other rows of its label, higher
    scores first, then smaller ids; the negatives of each are the first
    ``negatives`` rows of another label whose score is between ``low`` and
    ``high`` hundredths of the positive's.

    Anchors are linked to minimum spanning trees. Along a tree a row's score
    with an anchor lies within the parent's score, plus or minus the edge's
    length times the row's norm; only rows whose interval can reach the first
    positives, or meets a window whose first negatives it can enter, are
    scored again. Anchors travel in rounds of at most ``round_bytes``; each
    round reads the candidates twice where they lie and moves a task's first
    rows of each anchor only.

    Rows with a null id, label or vector, or a null or non-finite entry (or
    one without a long), take no part; a row meets anchors of its own
    dimension only; a score that no long holds counts as the nearest long.
    Rows that repeat an id are rows of their own, as anchors too, but never
    other rows to each other. Zero and negative scores have the windows that
    the inequality gives. Empty tables, or no anchors, give no rows; other
    columns are not read.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    clean = clean_rows(vectors, is_anchor, id_col, vector_col, label_col)
    rows, trees = clean.select("vec_id", "label", "v"), anchor_trees(clean)
    out_type = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    found = spark.createDataFrame([], out_type)
    for own in round_filters(trees, round_bytes):
        packed = [(r["tree"], r["packed"]) for r in trees.where(own).collect()]
        sent = spark.sparkContext.broadcast(packed)
        parts = rows.mapInArrow(lambda it: _positive_parts(it, sent.value, positives), "tree string, slot int, id long, score long")
        order = W.partitionBy("tree", "slot").orderBy(F.desc("score"), "id")
        best = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives).collect()
        lists: dict[tuple[str, int], list[tuple[int, int]]] = {}
        for r in sorted(best, key=lambda r: r["rank"]):
            lists.setdefault((r["tree"], r["slot"]), []).append((r["id"], r["score"]))
        sent.unpersist()
        sought = spark.sparkContext.broadcast(
            [(t, p, [lists.get((t, k), []) for k in range(len(p[0]) // 8)]) for t, p in packed])
        parts = rows.mapInArrow(
            lambda it: _negative_parts(it, sought.value, negatives, low, high),
            "tree string, slot int, p int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
        order = W.partitionBy("tree", "slot", "p").orderBy(F.desc("negative_score"), "negative_id")
        ranked = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        found = found.unionByName(materialize(
            ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
        sought.unpersist()
    return found
