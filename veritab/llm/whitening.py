"""Operator 11: whitening of embeddings by their leading principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, python_ready
from .eigen import EPS, leading_eigenpairs

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Columns of the covariance that are summed as one row.
TILE = 64
#: Entries beyond this have no long of their own and count as not finite.
LARGEST = float(1 << 62)


@dataclass
class Whitening:
    """What a fit has found; all of it is as large as the dimension or its
    square, whatever the number of vectors."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dimension(self) -> int:
        return len(self.sums)

    @property
    def spread(self) -> np.ndarray:
        """Which components have any variance, beyond rounding."""
        return self.values > 8 * EPS * self.dimension * max(self.trace, 0.0)

    def projection(self) -> np.ndarray:
        return self.components[:, self.spread] / np.sqrt(self.values[self.spread])


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (array of double) of the rows whose vector is whole."""
    v = col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) * SCALE >= LARGEST))
    return vectors.select(col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & ~bad)


def _matrices(batches: Iterator[pa.RecordBatch], dimension: int | None = None) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer matrix) of the vectors of each dimension in a batch, a few
    thousand at a time."""
    for batch in batches:
        ids, lists = batch.column("vec_id"), batch.column("v")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        for d in np.unique(lengths) if dimension is None else [dimension]:
            rows = np.flatnonzero(lengths == d)
            for at in range(0, len(rows), 4096):
                own = pa.array(rows[at:at + 4096])
                c = lists.take(own).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)
                yield ids.take(own), np.floor(SCALE * c).astype(np.int64) + SHIFT


def _exact_sums(x: np.ndarray) -> list[int]:
    if x.size and np.abs(x).max() >= (1 << 62) // len(x):
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, list[int]]] = {}
    for _, x in _matrices(batches):
        n, sums = found.get(x.shape[1], (0, [0] * x.shape[1]))
        found[x.shape[1]] = n + len(x), [a + b for a, b in zip(sums, _exact_sums(x))]
    for d, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()),
             pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["d", "i", "n", "s"])


def _centre(n: int, sums: list[int]) -> Callable[[np.ndarray], np.ndarray]:
    """x - S / n as doubles; the whole part of the mean goes exactly."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    return lambda x: (x - whole) - rest


def _products(batches: Iterator[pa.RecordBatch], n: int, sums: list[int]) -> Iterator[pa.RecordBatch]:
    d, centre = len(sums), _centre(n, sums)
    total = np.zeros((d, d))
    for _, x in _matrices(batches, d):
        c = centre(x)
        total += c.T @ c
    for j in range(0, d, TILE):
        tile = np.zeros((d, TILE))
        tile[:, :min(TILE, d - j)] = total[:, j:j + TILE]
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([j] * d, pa.int32()),
                                          pa.array(list(tile), pa.list_(pa.float64()))], names=["i", "j", "p"])


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over the dimensions of (n x - S)^2, exact at any size."""
    whole, rest = np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)
    a = x - whole
    reach = (float(np.abs(a).max(initial=0)) + 1) * n
    if reach ** 2 * len(sums) < 2.0 ** 62:
        y = a * n - rest
        return pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
    if reach < 2.0 ** 52 and len(sums) <= 512:  # high and low halves of 26 bits
        y = np.abs(a * n - rest)
        high, low = y >> 26, y & ((1 << 26) - 1)
        parts = (high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1)
        exact = [(h << 52) + (m << 27) + s for h, m, s in zip(*(p.tolist() for p in parts))]
    else:
        y = a.astype(object) * n - rest.astype(object)
        exact = (y * y).sum(axis=1).tolist()
    return pa.array([Decimal(e) if e < 10 ** 38 else None for e in exact], pa.decimal128(38, 0))


def _projected(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], projection: np.ndarray) -> Iterator[pa.RecordBatch]:
    centre = _centre(n, sums)
    for ids, x in _matrices(batches, len(sums)):
        w = centre(x) @ projection
        width = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
        yield pa.RecordBatch.from_arrays([ids, _deviations(x, n, sums), pa.ListArray.from_arrays(width, w.ravel())],
                                         names=["vec_id", "deviation", "whitened"])


def fit_whitening(clean: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of all cleaned vectors of the commonest
    dimension (of equally common ones the largest); None without any.

    Two passes, each with a partial result of at most the dimension's square
    per task: exact sums, then products of centred vectors, summed by row and
    tile on the executors. Only the sums over everything reach the driver.
    """
    spark = clean.sparkSession
    python_ready(spark)
    partial = clean.mapInArrow(_sums, "d int, i int, n long, s decimal(38,0)")
    sums = materialize(partial.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "white-sums")
    first = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not first:
        return None
    d, n = first[0]["d"], int(first[0]["n"])
    total = [int(r["s"]) for r in sums.where(F.col("d") == d).orderBy("i").collect()]
    parts = clean.mapInArrow(lambda it: _products(it, n, total), "i int, j int, p array<double>")
    rows = parts.groupBy("i", "j").agg(*[F.sum(F.col("p")[k]).alias(f"p{k}") for k in range(min(TILE, d))]).collect()
    covariance = np.zeros((d, d))
    for r in rows:
        own = r[2:2 + min(TILE, d - r["j"])]
        covariance[r["i"], r["j"]:r["j"] + len(own)] = own
    covariance = (covariance + covariance.T) / (2 * n)
    values, vectors = leading_eigenpairs(covariance, components)
    return Whitening(n, total, vectors, values, float(np.trace(covariance)))


def whiten(vectors: DataFrame, fitted: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, deviation, whitened`` of every whole vector of the fitted
    dimension: the projection on each component that varies, over the root of
    its eigenvalue; the projection matrix travels with the tasks. Rows of
    another dimension have no projection and are left out."""
    clean = clean_vectors(vectors, id_col, vector_col)
    kind = clean.schema["vec_id"].dataType.simpleString()
    n, sums, projection = fitted.n, fitted.sums, fitted.projection()
    return clean.mapInArrow(lambda it: _projected(it, n, sums, projection),
                            f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, width: int) -> float | None:
    """The largest absolute entry of the covariance of ``whitened`` minus the
    identity, centred before multiplying; None for no components."""
    if not width:
        return None
    w = [F.col("whitened")[i] for i in range(width)]
    means = white.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    centred = [c - F.lit(m) for c, m in zip(w, means)]
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    entries = white.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(e - (i == j)) for e, (i, j) in zip(entries, pairs))


def whitened_components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                        components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained,
    identity_error``, a row per whole vector and component.

    An entry c stands for floor(1024 c) + 100000. Rows with a null vector or a
    null or non-finite entry (or one that has no long) take no part; neither
    do vectors of another dimension than the commonest. Rows with a null id
    and repeated rows count like all others. ``deviation`` is null where it
    does not fit a long. A component without variance (constant or dependent
    dimensions, a single row) has no whitened value: null, explained 0 (null
    if nothing varies). There are as many components as dimensions if that is
    fewer. Empty tables and tables without a whole vector give no rows; other
    columns are not read.
    """
    fitted = fit_whitening(clean_vectors(vectors, id_col, vector_col), components)
    kind = vectors.schema[id_col].dataType.simpleString()
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, "
                                                        "whitened double, explained double, identity_error double")
    white = materialize(whiten(vectors, fitted, id_col, vector_col), "white")
    spread = fitted.spread
    place = np.cumsum(spread) - 1
    shares = [float(max(e, 0.0) / fitted.trace) if fitted.trace > 0 else None for e in fitted.values]
    rows = F.array(*[F.struct(F.lit(k + 1).alias("component"),
                              (F.col("whitened")[int(place[k])] if spread[k] else F.lit(None).cast("double")).alias("whitened"),
                              F.lit(shares[k]).cast("double").alias("explained")) for k in range(len(shares))])
    error = identity_error(white, int(spread.sum()))
    return (white.select("vec_id", F.expr("try_cast(deviation AS bigint)").alias("deviation"), F.explode(rows).alias("r"))
            .select("vec_id", "r.component", F.lit(fitted.n).cast("long").alias("n"), "deviation", "r.whitened",
                    "r.explained", F.lit(error).cast("double").alias("identity_error")))
