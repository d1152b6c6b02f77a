"""Distributed training of support vector machines and networks (M3-M6).

Training rows are packed once into blocks of a few thousand rows (numbers as
bytes, wide one-hot columns as compressed sparse rows), which stay persisted.
A pass sends weights to all tasks; every task sums losses and gradients over
its blocks, and Spark sums those by tile on the executors, at any number of
partitions. The driver keeps the L-BFGS history, as large as the weights.

A pass serves any number of models and several steps of each one's line
search: a grid of models over all folds takes the passes of its slowest fit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from itertools import combinations_with_replacement, product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions.exprs import as_double, qcol
from veritab.session import ship_package

BLOCK_ROWS = 4096
#: Numbers that are summed as one row: few for few weights, as a plan over
#: many columns takes longer to make than to run.
TILES = (8, 64)
#: Steps kept by L-BFGS, and the steps tried in one pass (after a failed one
#: ``SHRINK`` times those).
MEMORY, STEPS, SHRINK = 10, (1.0, 0.4, 0.1), 0.02
#: Row-weights of a pass from which a net with hidden layers tries the whole
#: step alone, and the shorter ones only where that fails.
LEAN = 1e8
#: Numbers of a hidden layer that are computed together, so that they stay in a core's cache.
CHUNK = 1 << 16
#: Rows whose mapped features are computed together, for the same.
MAP_ROWS = 2048
#: Half-width of the smooth corner of the hinge and the epsilon-insensitive loss.
CORNER = 0.02


# Feature maps ------------------------------------------------------------------

#: -sin(2 pi s) / s as a polynomial in s^2 for s up to a quarter of a turn, to the last digits of a double.
SINE = np.polynomial.chebyshev.Chebyshev.interpolate(lambda u: -2.0 * math.pi * np.sinc(2.0 * np.sqrt(np.maximum(u, 0.0))), 7, [0.0, 1 / 16]).convert(
    kind=np.polynomial.Polynomial).coef


def cosine(z: np.ndarray, part: int = 1 << 14) -> np.ndarray:
    """cos of ``z``, in place, by parts that fit into a core's cache."""
    flat = z.reshape(-1)
    square = np.empty(min(part, len(flat)))
    for at in range(0, len(flat), part):
        own = flat[at:at + part]
        u = square[:len(own)]
        # cos of r turns, |r| up to a half, is -sin of |r| - 1/4 turns
        own *= 0.5 / math.pi
        np.rint(own, out=u)
        own -= u
        np.abs(own, out=own)
        own -= 0.25
        np.multiply(own, own, out=u)
        p = u * SINE[-1]
        for c in SINE[-2:0:-1]:
            p += c
            p *= u
        p += SINE[0]
        own *= p
    return z


@lru_cache(64)
def _fourier(gamma: float, n: int, seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n, width))
    return np.ascontiguousarray(w.T), rng.uniform(0.0, 2.0 * math.pi, size=n)


@dataclass
class RandomFourier:
    """cos(w.x + b) features of the RBF kernel exp(-gamma |x - y|^2)."""

    gamma: float
    n: int = 100
    seed: int = 42

    def __call__(self, x: np.ndarray) -> np.ndarray:
        w, b = _fourier(self.gamma, self.n, self.seed, x.shape[1])
        z = x @ w
        z += b
        cosine(z)
        z *= math.sqrt(2.0 / self.n)
        return z


@dataclass
class TensorSketch:
    """Features of the polynomial kernel (gamma x.y + coef0)^degree: count
    sketches of x, combined by their Fourier transforms (Pham and Pagh, 2013)."""

    gamma: float
    coef0: float = 0.0
    degree: int = 3
    n: int = 256
    seed: int = 42

    def __call__(self, x: np.ndarray) -> np.ndarray:
        base, mix = self.basis(x)
        return base if mix is None else base @ mix

    def basis(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(b, m) with features b @ m (b itself without m). Where few features
        have fewer monomials than the sketch has entries, b is those."""
        z = math.sqrt(self.gamma) * x
        if self.coef0:
            z = np.column_stack([z, np.full(len(x), math.sqrt(self.coef0))])
        signs = _sketches(x.shape[1] + 1, self.n, self.degree, self.seed)
        if math.comb(z.shape[1] + self.degree - 1, self.degree) <= self.n and z.shape[1] ** self.degree <= 1 << 16:
            own, mix = _monomials(z.shape[1], x.shape[1] + 1, self.n, self.degree, self.seed)
            base = np.empty((len(own), len(x)))
            columns = np.ascontiguousarray(z.T)
            for out, factors in zip(base, own):
                out[:] = columns[factors[0]]
                for f in factors[1:]:
                    out *= columns[f]
            return base.T, mix
        terms = 1.0
        for places, sign in signs:
            sketch = np.zeros((z.shape[1], self.n))
            sketch[np.arange(z.shape[1]), places[:z.shape[1]]] = sign[:z.shape[1]]
            terms = terms * (z @ np.fft.rfft(sketch, axis=1))
        return np.fft.irfft(terms, self.n, axis=1), None


@lru_cache(64)
def _sketches(width: int, n: int, degree: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, sign) of every entry, for each factor of the kernel."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(degree):
        sign = rng.choice([-1.0, 1.0], width)
        out.append((rng.integers(0, n, width), sign))
    return out


@lru_cache(64)
def _monomials(width: int, drawn: int, n: int, degree: int, seed: int) -> tuple[list[tuple], np.ndarray]:
    """The monomials of ``degree`` in ``width`` numbers, and what each adds to the sketch's entries."""
    own = list(combinations_with_replacement(range(width), degree))
    at, mix = {m: k for k, m in enumerate(own)}, np.zeros((len(own), n))
    signs = _sketches(drawn, n, degree, seed)
    for factors in product(range(width), repeat=degree):
        place = sum(int(p[f]) for f, (p, _) in zip(factors, signs)) % n
        mix[at[tuple(sorted(factors))], place] += math.prod(float(s[f]) for f, (_, s) in zip(factors, signs))
    return own, mix


@dataclass
class Landmarks:
    """Nystroem features of the sigmoid kernel tanh(gamma x.y + coef0): kernel
    values with the landmarks, times the root of the inverse of the landmarks'
    own kernel matrix (its positive part, as the kernel is indefinite)."""

    points: list
    gamma: float
    coef0: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        points = np.array(self.points)
        values, vectors = np.linalg.eigh(np.tanh(self.gamma * points @ points.T + self.coef0))
        keep = values > 1e-8 * np.abs(values).max(initial=1e-300)
        return np.tanh(self.gamma * x @ points.T + self.coef0) @ (vectors[:, keep] / np.sqrt(values[keep]))


FEATURE_MAPS = {m.__name__: m for m in (RandomFourier, TensorSketch, Landmarks)}


# Blocks ----------------------------------------------------------------------

@dataclass
class Sparse:
    """Compressed sparse rows."""

    pointer: np.ndarray
    index: np.ndarray
    value: np.ndarray

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        terms = np.concatenate([self.value[:, None] * w[self.index], np.zeros((1, w.shape[1]))])
        sums = np.add.reduceat(terms, self.pointer[:-1], axis=0)
        sums[self.pointer[:-1] == self.pointer[1:]] = 0.0  # an empty row would get the next one's first term
        return sums

    def transposed_times(self, delta: np.ndarray, size: int) -> np.ndarray:
        rows = np.repeat(np.arange(len(self.pointer) - 1), np.diff(self.pointer))
        out = np.zeros((size, delta.shape[1]))
        order, starts = self.by_slot
        if len(order):
            out[self.index[order[starts]]] = np.add.reduceat(self.value[order][:, None] * delta[rows[order]], starts, axis=0)
        return out

    @cached_property
    def by_slot(self) -> tuple[np.ndarray, np.ndarray]:
        """The entries in the order of their slots, and where each slot starts."""
        order = np.argsort(self.index, kind="stable")
        own = self.index[order]
        return order, np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)

    def rows(self, keep: np.ndarray) -> Sparse:
        size = np.diff(self.pointer)
        entries = np.repeat(keep, size)
        return Sparse(np.concatenate([[0], np.cumsum(size[keep])]), self.index[entries], self.value[entries])

    @classmethod
    def of_column(cls, column: pa.Array) -> Sparse:
        """From vectors as (type, size, indices, values): 0 sparse, 1 dense."""
        kind, _, indices, values = column.flatten()
        if not (kind.null_count or pa.compute.max(kind).as_py()):
            size = pa.compute.list_value_length(indices).to_numpy(zero_copy_only=False)
            return cls(np.concatenate([[0], np.cumsum(size)]).astype(np.int64), indices.flatten().to_numpy().astype(np.int64),
                       values.flatten().to_numpy().astype(float))
        own = column.to_pylist()
        index = [range(len(r["values"])) if r["type"] else r["indices"] for r in own]
        return cls(np.concatenate([[0], np.cumsum([len(i) for i in index])]).astype(np.int64),
                   np.concatenate([np.asarray(i, np.int64) for i in index]) if own else np.zeros(0, np.int64),
                   np.concatenate([np.asarray(r["values"], float) for r in own]) if own else np.zeros(0))


@dataclass
class Block:
    x: np.ndarray
    wide: Sparse | None
    y: np.ndarray
    fold: np.ndarray

    def rows(self, keep: np.ndarray) -> Block:
        return Block(self.x[keep], self.wide.rows(keep) if self.wide else None, self.y[keep], self.fold[keep])


BLOCK_TYPE = "x binary, y binary, fold binary, pointer binary, position binary, value binary"


def _packed(batches: Iterator[pa.RecordBatch], width: int, has_wide: bool) -> Iterator[pa.RecordBatch]:
    names = ["x", "y", "fold", "pointer", "position", "value"]
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(part.num_rows, width)
            wide = Sparse.of_column(part.column("wide")) if has_wide else None
            raw = [x, part.column("y").to_numpy(zero_copy_only=False).astype("<f8"),
                   part.column("fold").to_numpy(zero_copy_only=False).astype("<i4"),
                   *((wide.pointer, wide.index, wide.value) if wide else (np.zeros(0),) * 3)]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary()) for r in raw], names=names)


def _unpacked(batches: Iterator[pa.RecordBatch], width: int, has_wide: bool) -> Iterator[Block]:
    def read(cell, kind):  # block by block: a batch holds those of a whole task
        return np.frombuffer(cell.as_buffer(), kind)

    for batch in batches:
        for x, y, fold, *own in zip(*batch.columns):
            wide = Sparse(*map(read, own, (np.int64, np.int64, float))) if has_wide else None
            y = read(y, "<f8")
            yield Block(read(x, "<f8").reshape(len(y), width), wide, y, read(fold, "<i4"))


@dataclass
class Moments:
    """Mean and deviation of the dense features and the label."""

    n: int
    mean: np.ndarray
    std: np.ndarray

    @property
    def of_label(self) -> tuple[float, float]:
        return float(self.mean[-1]), float(self.std[-1]) or 1.0


@dataclass
class Table:
    """Packed training rows. ``wide`` names the vector columns, ``slots``
    counts their entries, ``folds`` the values of the fold column."""

    blocks: DataFrame
    features: list[str]
    wide: list[str]
    slots: int
    folds: int
    moments: dict = field(default_factory=dict)

    @property
    def dense(self) -> list[str]:
        return [f for f in self.features if f not in self.wide]

    def sum(self, size: int, fn: Callable[[Block], np.ndarray], shared=None) -> np.ndarray:
        """The sum of ``fn(block, shared)`` (``size`` numbers) over all blocks;
        ``shared`` is broadcast."""
        spark = self.blocks.sparkSession
        sent = spark.sparkContext.broadcast(shared)
        width, has_wide = len(self.dense), bool(self.wide)
        tile = min(TILES[1], max(TILES[0], size // 256))

        def part(batches):
            total = np.zeros(-(-size // tile) * tile)
            seen = False
            for block in _unpacked(batches, width, has_wide):
                total[:size] += fn(block, sent.value)
                seen = True
            if seen:
                tiles = total.reshape(-1, tile)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(tiles)), pa.int32()), pa.array(list(tiles), pa.list_(pa.float64()))],
                                                 names=["tile", "v"])

        rows = (self.blocks.mapInArrow(part, "tile int, v array<double>").groupBy("tile")
                .agg(*[F.sum(F.col("v")[k]).alias(f"v{k}") for k in range(tile)]).collect())
        sent.unpersist()
        out = np.zeros((-(-size // tile), tile))
        for r in rows:
            out[r[0]] = r[1:]
        return out.ravel()[:size]

    def fit_moments(self) -> None:
        """Moments of all rows (key None) and of those outside each fold."""
        d, k = len(self.dense) + 1, max(self.folds, 1)

        def sums(block, _):
            xy, out = np.column_stack([block.x, block.y]), np.zeros((k, 2 * d + 1))
            for f in range(k):
                own = xy[block.fold == f]
                out[f] = np.concatenate([[len(own)], np.isnan(own).sum(axis=0), np.nansum(own, axis=0)])
            return out.ravel()

        first = self.sum(k * (2 * d + 1), sums).reshape(k, -1)
        holes = [c for c, missing in zip(self.dense, first[:, 1:d].sum(axis=0)) if missing]
        if holes:
            raise ValueError(f"features with missing values: {holes}; drop or fill them first")
        n, means = first[:, 0], first[:, d + 1:] / np.maximum(first[:, :1], 1)
        if not n.sum():
            raise ValueError("no rows with a label")

        def squares(block, means):
            xy, out = np.column_stack([block.x, block.y]), np.zeros((k, d))
            for f in range(k):
                out[f] = ((xy[block.fold == f] - means[f]) ** 2).sum(axis=0)
            return out.ravel()

        inside = self.sum(k * d, squares, means).reshape(k, d)
        for left_out in [None, *range(self.folds)]:
            own = [f for f in range(k) if f != left_out and n[f]]
            total = max(n[own].sum(), 1)
            mean = (n[own][:, None] * means[own]).sum(axis=0) / total
            between = (n[own][:, None] * (means[own] - mean) ** 2).sum(axis=0)
            std = np.sqrt((inside[own].sum(axis=0) + between) / total)
            std[:-1][std[:-1] == 0] = 1.0
            self.moments[left_out] = Moments(int(n[own].sum()), mean, std)

    def close(self) -> None:
        self.blocks.unpersist()


def wide_columns(df: DataFrame, features: list[str]) -> list[str]:
    return [c for c in features if isinstance(df.schema[c].dataType, VectorUDT)]


def _inputs(df: DataFrame, features: list[str], wide: list[str]):
    """(frame, dense array, wide struct or None): the features as two columns."""
    dense = F.array(*[as_double(c, df.schema[c].dataType) for c in features if c not in wide]).cast("array<double>")
    if not wide:
        return df, dense, None
    own = df.withColumns({f"__wide_{i}": qcol(c) for i, c in enumerate(wide)})
    joined = VectorAssembler(inputCols=[f"__wide_{i}" for i in range(len(wide))], outputCol="__wide").transform(own)
    return joined.drop(*[f"__wide_{i}" for i in range(len(wide))]), dense, F.unwrap_udt(F.col("__wide"))


def pack(df: DataFrame, features: list[str], label: str, fold: str | None = None, folds: int = 0) -> Table:
    """Rows with a label as persisted blocks. ``fold`` is a column of
    0..folds-1; without it, and with ``folds``, a hash of the row deals them."""
    ship_package(df.sparkSession)
    wide = wide_columns(df, features)
    frame, dense, vectors = _inputs(df.where(qcol(label).isNotNull()), features, wide)
    if fold is not None:
        number = qcol(fold).cast("int")
    elif folds:
        # xxhash64 has its own seeds; a fixed extra value keeps it apart from other hashes of the row
        number = F.pmod(F.xxhash64(dense, qcol(label), F.lit("folds")), F.lit(folds)).cast("int")
    else:
        number = F.lit(0)
    rows = frame.select(dense.alias("x"), qcol(label).cast("double").alias("y"), number.alias("fold"),
                        *([vectors.alias("wide")] if wide else []))
    slots = 0
    if wide:
        first = rows.select("wide").first()
        slots = 0 if first is None else first["wide"]["size"] or len(first["wide"]["values"])
    width, has_wide = len(features) - len(wide), bool(wide)
    blocks = rows.mapInArrow(lambda it: _packed(it, width, has_wide), BLOCK_TYPE).persist()
    table = Table(blocks, features, wide, slots, folds)
    try:
        table.fit_moments()
    except BaseException:
        table.close()
        raise
    return table


# Losses and networks ---------------------------------------------------------

def _act(name: str):
    """The activation, which may write over its input, and its slope by its own value."""
    if name == "relu":
        return (lambda z: np.maximum(z, 0.0, out=z)), (lambda a: a > 0)
    if name == "tanh":
        return (lambda z: np.tanh(z, out=z)), (lambda a: 1.0 - a * a)
    if name in ("logistic", "sigmoid"):
        return (lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))), (lambda a: a * (1.0 - a))
    if name == "identity":
        return (lambda z: z), (lambda a: np.ones_like(a))
    raise ValueError(f"unknown activation {name!r}")


def _corner(excess: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """max(excess, 0) with a smooth corner, and its slope."""
    inside = np.clip(excess, 0.0, CORNER)
    value = np.maximum(excess, 0.0)
    value -= inside
    slope = inside / CORNER
    inside *= slope
    inside *= 0.5
    value += inside
    return value, slope


def loss_and_delta(out: np.ndarray, y: np.ndarray, loss: str, epsilon: float) -> tuple[float, np.ndarray]:
    """The loss summed over the rows and its derivative by the outputs."""
    if loss == "squared":
        r = out[:, 0] - y
        return float(0.5 * (r @ r)), r[:, None]
    if loss == "epsilon_insensitive":
        r = out[:, 0] - y
        value, slope = _corner(np.abs(r) - epsilon)
        return float(value.sum()), (np.sign(r) * slope)[:, None]
    if loss == "hinge":  # one output for two classes, else one class against the others each
        target = np.where(y[:, None] == (np.arange(out.shape[1]) if out.shape[1] > 1 else 1), 1.0, -1.0)
        value, slope = _corner(1 - target * out)
        return float(value.sum()), -target * slope
    if loss != "softmax":
        raise ValueError(f"unknown loss {loss!r}")
    z = out - out.max(axis=1, keepdims=True)
    log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    at = (np.arange(len(y)), y.astype(int))
    delta = np.exp(log_p)
    delta[at] -= 1.0
    return float(-log_p[at].sum()), delta


@dataclass
class Net:
    """What is to be trained. ``classes`` counts the classes of softmax and
    hinge; ``penalty`` weighs half the squared weights against the summed loss
    (``raw_penalty``: the weights of the features as they are)."""

    loss: str
    hidden: tuple = ()
    activation: str = "relu"
    classes: int = 1
    penalty: float = 1e-4
    raw_penalty: bool = False
    epsilon: float = 0.1
    seed: int = 42
    max_iter: int = 200
    tol: float = 1e-5
    without_fold: int | None = None
    feature_map: object = None

    def outputs(self) -> int:
        return 1 if self.loss in ("squared", "epsilon_insensitive") or (self.loss == "hinge" and self.classes == 2) else self.classes

    def shapes(self, width: int) -> list[tuple]:
        sizes = [width, *self.hidden, self.outputs()]
        return [s for a, b in zip(sizes[:-1], sizes[1:]) for s in ((a, b), (b,))]

    def start(self, width: int) -> np.ndarray:
        rng, parts = np.random.default_rng(self.seed), []
        for shape in self.shapes(width):
            random = self.hidden and len(shape) == 2
            bound = math.sqrt(6.0 / sum(shape)) if random else 0.0
            parts.append(rng.uniform(-bound, bound, size=shape).ravel() if random else np.zeros(shape).ravel())
        return np.concatenate(parts)


def unflatten(flat: np.ndarray, shapes: list[tuple]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        size = math.prod(shape)
        out.append(flat[at:at + size].reshape(shape))
        at += size
    return out


def forward(weights: list[np.ndarray], x: np.ndarray, wide: Sparse | None, activation: str) -> list[np.ndarray]:
    """Activations of every layer behind the input; the last are the outputs."""
    f, _ = _act(activation)
    width = x.shape[1]
    z = x @ weights[0][:width]
    z += weights[1]
    if wide is not None:
        z += wide @ weights[0][width:]
    layers = []
    for k in range(2, len(weights), 2):
        layers.append(f(z))
        z = layers[-1] @ weights[k]
        z += weights[k + 1]
    return [*layers, z]


def loss_and_gradient(net: Net, weights: list[np.ndarray], x: np.ndarray, wide: Sparse | None, y: np.ndarray,
                      epsilon: float) -> tuple[float, np.ndarray]:
    _, slope = _act(net.activation)
    layers = forward(weights, x, wide, net.activation)
    value, delta = loss_and_delta(layers[-1], y, net.loss, epsilon)
    parts = []
    for k in range(len(weights) - 2, -1, -2):
        if k:
            below = layers[k // 2 - 1]
            parts = [(below.T @ delta).ravel(), delta.sum(axis=0), *parts]
            delta = delta @ weights[k].T
            delta *= slope(below)
        else:
            first = x.T @ delta
            if wide is not None:
                first = np.concatenate([first, wide.transposed_times(delta, len(weights[0]) - x.shape[1])])
            parts = [first.ravel(), delta.sum(axis=0), *parts]
    return value, np.concatenate(parts)


@dataclass
class Inputs:
    """How a net reads features: standardised, or as they are through a map."""

    mean: np.ndarray
    std: np.ndarray
    feature_map: object = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.feature_map(x) if self.feature_map is not None else (x - self.mean) / self.std


def _columns(block: Block, own: list[tuple]) -> list[list[np.ndarray]]:
    """(loss, gradient) of nets without hidden layers that read the same features
    and share a loss: all outputs at all points are columns of one product, and
    the rows that a net leaves out have no part in its columns."""
    net, inputs = own[0][:2]
    width, scaled = own[0][4][0][0], inputs.feature_map is None
    # wide columns are summed by slot, once for all rows
    size = MAP_ROWS if not scaled and block.wide is None else len(block.y)
    dense = width if block.wide is None else (block.x.shape[1] if scaled else inputs(np.zeros((1, block.x.shape[1]))).shape[1])
    # (x - mean) / std of another net is that of the first, scaled and shifted
    reads = [(inputs.std / i.std, (inputs.mean - i.mean) / i.std) for _, i, *_ in own] if scaled else []
    slopes, bias, seen, spots = [], [], [], []
    for k, (n, _, y_mean, y_std, shapes, points) in enumerate(own):
        for point in points:
            w, b = unflatten(point, shapes)
            if scaled:
                scale, shift = reads[k]
                b = b + shift @ w[:dense]
                w = np.concatenate([scale[:, None] * w[:dense], w[dense:]])
            slopes.append(w)
            bias.append(b)
            for output in range(len(b)):
                seen.append(-1 if n.without_fold is None else n.without_fold)
                spots.append((output if len(b) > 1 else 1, y_mean, y_std, n.epsilon / y_std))  # class, label, corridor
    w, bias, folds, spot = np.concatenate(slopes, axis=1), np.concatenate(bias), np.array(seen, np.int32), np.array(spots)
    one_class = (spot[:, 0] == spot[0, 0]).all()
    values, sums, gradient, wide, mix, top = 0.0, 0.0, 0.0, [], None, None
    for at in range(0, len(block.y), size):
        x, y, fold = block.x[at:at + size], block.y[at:at + size, None], block.fold[at:at + size, None]
        if hasattr(inputs.feature_map, "basis"):
            base, mix = inputs.feature_map.basis(x)
        else:
            base = inputs(x)
        if top is None:
            top = w[:dense] if mix is None else mix @ w[:dense]
        out = base @ top
        out += bias
        if block.wide is not None:
            out += block.wide @ w[dense:]
        # a row that a net leaves out has no excess there, and so neither loss nor slope
        kept = fold != folds if (folds >= 0).any() else 1.0
        if net.loss == "hinge":
            target = np.where(y == (spot[:1, 0] if one_class else spot[:, 0]), 1.0, -1.0)
            out *= target
            np.subtract(1.0, out, out=out)
            out *= kept
            value, delta = _corner(out)
            delta *= -target
        else:
            out -= (y - spot[:, 1]) / spot[:, 2]
            out *= kept
            if net.loss == "squared":
                value, delta = 0.5 * out * out, out
            else:
                value, delta = _corner((np.abs(out) - spot[:, 3]) * kept)
                delta *= np.sign(out)
        values, sums, gradient = values + value.sum(axis=0), sums + delta.sum(axis=0), gradient + base.T @ delta
        if block.wide is not None:
            wide = [block.wide.transposed_times(delta, width - dense)]
    if mix is not None:
        gradient = mix.T @ gradient
    parts, at = [], 0
    for k, (*_, shapes, points) in enumerate(own):
        found, size = [], shapes[1][0]
        for _ in points:
            columns = slice(at, at + size)
            first = gradient[:, columns]
            if scaled:
                scale, shift = reads[k]
                first = scale[:, None] * first + shift[:, None] * sums[columns]
            found += [[values[columns].sum()], first.ravel(), *[v[:, columns].ravel() for v in wide], sums[columns]]
            at += size
        parts.append(found)
    return parts


def _evaluate(block: Block, shared) -> np.ndarray:
    """(loss, gradient) of every net at each of its points, one behind the other."""
    parts, kept, together = [None] * len(shared), {}, {}
    for k, (net, inputs, *_) in enumerate(shared):
        if not net.hidden and net.loss != "softmax":
            together.setdefault((net.loss, repr(inputs.feature_map)), []).append(k)
    for group in together.values():
        for k, found in zip(group, _columns(block, [shared[k] for k in group])):
            parts[k] = found
    for k, (net, inputs, y_mean, y_std, shapes, points) in enumerate(shared):
        if parts[k] is not None:
            continue
        if net.without_fold not in kept:
            kept[net.without_fold] = (block if net.without_fold is None else block.rows(block.fold != net.without_fold), {})
        own, read = kept[net.without_fold]
        key = repr(inputs.feature_map)
        if key not in read:
            read[key] = inputs(own.x)
        x, y = read[key], (own.y - y_mean) / y_std
        size = max(512, CHUNK // max(net.hidden, default=1)) if own.wide is None else max(1, len(y))
        chunks = [slice(a, a + size) for a in range(0, len(y), size)]
        parts[k] = []
        for point in points:
            weights, value, gradient = unflatten(point, shapes), 0.0, np.zeros(len(point))
            for c in chunks:
                v, g = loss_and_gradient(net, weights, x[c], own.wide, y[c], net.epsilon / y_std)
                value += v
                gradient += g
            parts[k] += [[value], gradient]
    return np.concatenate([p for found in parts for p in found])


@dataclass
class Search:
    """L-BFGS of one net, between passes."""

    net: Net
    point: np.ndarray
    value: float = math.inf
    gradient: np.ndarray | None = None
    pairs: list = field(default_factory=list)
    history: list = field(default_factory=list)
    steps: list = field(default_factory=list)
    shrunk: int = 0
    stale: int = 0
    done: bool = False
    lean: bool = False
    whole_failed: bool = False

    def direction(self) -> np.ndarray:
        q, alphas = self.gradient.copy(), []
        for s, y, rho in reversed(self.pairs):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * y
        if self.pairs:
            s, y, _ = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(self.pairs, reversed(alphas)):
            q += s * (a - rho * (y @ q))
        return -q

    def points(self) -> list[np.ndarray]:
        if self.gradient is None:
            self.steps = [0.0]
            self.way = np.zeros_like(self.point)
        else:
            self.way = self.direction()
            if self.way @ self.gradient >= 0:
                self.pairs, self.way = [], -self.gradient
            first = 1.0 if self.pairs else 1 / max(1e-12, float(np.linalg.norm(self.gradient)))
            tried = STEPS
            if self.lean and self.pairs and not self.shrunk:
                tried = STEPS[1:] if self.whole_failed else STEPS[:1]
            self.steps = [first * SHRINK ** self.shrunk * t for t in tried]
        return [self.point + t * self.way for t in self.steps]

    def take(self, found: list[tuple[float, np.ndarray]]) -> None:
        if self.gradient is None:
            self.value, self.gradient = found[0]
            self.history.append(self.value)
            return
        slope = float(self.way @ self.gradient)
        good = [(f, k) for k, (f, _) in enumerate(found) if np.isfinite(f) and f <= self.value + 1e-4 * self.steps[k] * slope]
        if not good and len(found) == 1:
            self.whole_failed = True
            return
        self.whole_failed = False
        if not good:
            self.shrunk += 1
            if self.shrunk > 3:
                if self.pairs:  # a poor direction: once more from the gradient itself
                    self.pairs, self.shrunk = [], 0
                else:
                    self.done = True
            return
        value, k = min(good)
        gradient = found[k][1]
        s, y = self.steps[k] * self.way, gradient - self.gradient
        if s @ y > 1e-10 * np.linalg.norm(s) * np.linalg.norm(y):
            self.pairs = [*self.pairs, (s, y, 1 / (s @ y))][-MEMORY:]
        small = self.value - value <= self.net.tol * max(abs(self.value), 1.0)
        self.stale = self.stale + 1 if small else 0
        self.point, self.value, self.gradient, self.shrunk = self.point + s, value, gradient, 0
        self.history.append(value)
        self.done = self.stale >= 3 or len(self.history) > self.net.max_iter or float(np.abs(gradient).max()) < 1e-8


def fit_nets(table: Table, nets: list[Net], features: list[str] | None = None) -> list[GradientModel]:
    """Train all nets together on ``table``; a pass serves every net that has
    not ended."""
    searches, reads = [], []
    for net in nets:
        m = table.moments[net.without_fold]
        if not m.n:
            raise ValueError("no rows with a label outside the fold")
        inputs = Inputs(m.mean[:-1], m.std[:-1], net.feature_map)
        width = inputs(np.zeros((1, len(table.dense)))).shape[1]
        y_mean, y_std = m.of_label if net.loss in ("squared", "epsilon_insensitive") else (0.0, 1.0)
        shapes = net.shapes(width + table.slots)
        scale = np.ones(shapes[0][0])
        if net.raw_penalty and net.feature_map is None:
            scale[:width] = 1 / inputs.std
        # weights are penalised, intercepts are not
        weigh = [(scale[:, None] if k == 0 else 1.0) * np.ones(s) if len(s) == 2 else np.zeros(s) for k, s in enumerate(shapes)]
        penalty = net.penalty * np.concatenate([w.ravel() ** 2 for w in weigh])
        start = net.start(shapes[0][0])
        searches.append(Search(net, start, lean=bool(net.hidden) and m.n * len(start) >= LEAN))
        reads.append((inputs, y_mean, y_std, shapes, penalty, m.n))
    while active := [k for k, s in enumerate(searches) if not s.done]:
        points = [searches[k].points() for k in active]
        shared = [(searches[k].net, *reads[k][:4], p) for k, p in zip(active, points)]
        flat = table.sum(sum(len(p) * (1 + len(p[0])) for p in points), _evaluate, shared)
        at = 0
        for k, own in zip(active, points):
            *_, penalty, n = reads[k]
            found = []
            for p in own:
                size = len(p)
                found.append(((flat[at] + 0.5 * float(penalty @ p ** 2)) / n, (flat[at + 1:at + 1 + size] + penalty * p) / n))
                at += 1 + size
            searches[k].take(found)
    models = []
    for s, (inputs, y_mean, y_std, shapes, _, _) in zip(searches, reads):
        models.append(GradientModel(features or table.features, unflatten(s.point, shapes), s.net.activation, s.net.loss, s.net.classes,
                                    inputs.mean, inputs.std, y_mean, y_std, s.net.feature_map, list(table.wide), s.history))
    return models


# Calibration -----------------------------------------------------------------

def fit_platt(table: Table, models: list[GradientModel], max_steps: int = 50) -> list[tuple[float, float]]:
    """(a, b) per class: the probability 1 / (1 + exp(a m + b)) of margin m,
    by Newton steps on margins of the models that did not see the row
    (``models[f]`` for fold f), with Platt's smoothed targets."""
    k = models[0].margin_count()
    # the steps read the margins many times and the features never again
    own = _margin_table(table, models)

    def hits(block: Block) -> np.ndarray:
        return block.y[:, None] == (np.arange(k) if k > 1 else 1)

    try:
        counts = own.sum(2 * k, lambda b, _: np.concatenate([(h := hits(b)).sum(axis=0), (~h).sum(axis=0)]))
        return _platt_steps(own, k, counts, hits, max_steps)
    finally:
        own.close()


def _margin_table(table: Table, models: list[GradientModel]) -> Table:
    """The rows with the margins of the model that did not see them as features."""
    sent = table.blocks.sparkSession.sparkContext.broadcast(models)
    width, has_wide = len(table.dense), bool(table.wide)

    def part(batches):
        for block in _unpacked(batches, width, has_wide):
            out, y = [], []
            for f, model in enumerate(sent.value):
                rows = block.rows(block.fold == f)
                out.append(model.margins(rows.x, rows.wide))
                y.append(rows.y)
            raw = [np.concatenate(out).astype("<f8"), np.concatenate(y).astype("<f8"), np.zeros(len(block.y), "<i4"), *(np.zeros(0),) * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary()) for r in raw],
                                             names=["x", "y", "fold", "pointer", "position", "value"])

    return Table(table.blocks.mapInArrow(part, BLOCK_TYPE).persist(), [f"margin {i}" for i in range(models[0].margin_count())], [], 0, 0)


def _platt_steps(table: Table, k: int, counts: np.ndarray, hits: Callable, max_steps: int) -> list[tuple[float, float]]:
    pos, neg = counts[:k], counts[k:]
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)

    def newton(block, shared):
        a, b = shared
        m, hit = block.x, hits(block)
        t = np.where(hit, high, low)
        z = a * m + b
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        loss = np.logaddexp(0, z) - (1 - t) * z  # -t log p - (1 - t) log(1 - p)
        v = p * (1 - p)
        return np.concatenate([c.sum(axis=0) for c in (loss, m * (t - p), t - p, m * m * v, m * v, v)])

    a, b = np.zeros(k), np.log((neg + 1) / (pos + 1))
    best, step_a, step_b, share = np.full(k, np.inf), np.zeros(k), np.zeros(k), np.ones(k)
    for _ in range(max_steps):
        loss, ga, gb, haa, hab, hbb = table.sum(6 * k, newton, (a, b)).reshape(6, k)
        worse = loss > best + 1e-9 * np.abs(best)
        share = np.where(worse, share / 2, 1.0)
        if not worse.any() and max(np.abs(ga).max(), np.abs(gb).max()) < 1e-6 * max(1.0, counts.sum()):
            break
        # a class whose loss rose goes back by half of its last step
        best = np.where(worse, best, loss)
        haa, hbb = haa + 1e-9, hbb + 1e-9
        det = haa * hbb - hab ** 2
        new_a, new_b = -(hbb * ga - hab * gb) / det, -(haa * gb - hab * ga) / det
        step_a, step_b = np.where(worse, -step_a / 2, new_a), np.where(worse, -step_b / 2, new_b)
        a, b = a + step_a, b + step_b
    return [(float(x), float(z)) for x, z in zip(a, b)]


# Models ----------------------------------------------------------------------

@dataclass
class GradientModel:
    """A trained net. Regression gives ``prediction``; classification also
    ``probability``, and a hinge model ``rawPrediction``, its margins."""

    features: list[str]
    weights: list
    activation: str
    loss: str
    classes: int
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: float = 0.0
    y_std: float = 1.0
    feature_map: object = None
    wide: list[str] = field(default_factory=list)
    history: list | None = None
    platt: list | None = None
    prediction: str = "prediction"

    @staticmethod
    def fit(df: DataFrame, features: list[str], label: str, loss: str = "squared", hidden=(100,), activation: str = "relu",
            alpha: float = 1e-4, max_iter: int = 200, seed: int = 42, epsilon: float = 0.1, n_classes: int | None = None,
            tol: float = 1e-5, lr: float | None = None) -> GradientModel:
        """One net on its own (``lr`` has no effect)."""
        table = pack(df, features, label)
        try:
            return fit_nets(table, [Net(loss, tuple(hidden), activation, n_classes or 1, alpha, False, epsilon, seed, max_iter, tol)])[0]
        finally:
            table.close()

    def margin_count(self) -> int:
        return self.weights[-1].shape[0]

    def margins(self, x: np.ndarray, wide: Sparse | None = None) -> np.ndarray:
        return forward(self.weights, Inputs(self.x_mean, self.x_std, self.feature_map)(x), wide, self.activation)[-1]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds the outputs with an Arrow UDF. A row with a missing feature
        gets NULLs; of equal outputs the first class is predicted."""
        spark = df.sparkSession
        ship_package(spark)
        sent = spark.sparkContext.broadcast(self)
        frame, dense, vectors = _inputs(df, self.features, self.wide)
        width = len(self.features) - len(self.wide)

        def scored(x: pa.Array, wide: pa.Array | None = None) -> pa.Array:
            rows = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), width)
            out = sent.value.margins(rows, None if wide is None else Sparse.of_column(wide))
            at = np.arange(len(x) + 1, dtype=np.int32) * out.shape[1]
            return pa.ListArray.from_arrays(pa.array(at), pa.array(out.ravel()), mask=pa.array(np.isnan(rows).any(axis=1)))

        if vectors is None:
            def outputs(x: pa.Array) -> pa.Array:
                return scored(x)
            out = frame.withColumn("__out", F.arrow_udf(outputs, T.ArrayType(T.DoubleType()))(dense))
        else:
            def both(x: pa.Array, wide: pa.Array) -> pa.Array:
                return scored(x, wide)
            out = frame.withColumn("__out", F.arrow_udf(both, T.ArrayType(T.DoubleType()))(dense, vectors)).drop("__wide")
        o = F.col("__out")
        if self.loss in ("squared", "epsilon_insensitive"):
            return out.withColumn(self.prediction, o[0] * self.y_std + self.y_mean).drop("__out")
        if self.loss == "hinge":
            margins = F.array(-o[0], o[0]) if self.margin_count() == 1 else o
            platt = self.platt or [(-1.0, 0.0)] * self.margin_count()
            each = [1 / (1 + F.exp(F.lit(a) * o[k] + F.lit(b))) for k, (a, b) in enumerate(platt)]
            each = F.array(1 - each[0], each[0]) if len(each) == 1 else F.array(*each)
            out = out.withColumn("rawPrediction", F.when(o.isNotNull(), array_to_vector(margins)))
        else:
            margins, each = o, F.transform("__out", lambda z: F.exp(z - F.array_max("__out")))
        total = F.aggregate(each, F.lit(0.0), lambda s, p: s + p)
        best = (F.array_position(margins, F.array_max(margins)) - 1).cast("double")
        return (out.withColumn(self.prediction, F.when(o.isNotNull(), best))
                .withColumn("probability", F.when(o.isNotNull(), array_to_vector(F.transform(each, lambda p: p / total)))).drop("__out"))

    def to_dict(self) -> dict:
        own = {k: v for k, v in vars(self).items() if k != "feature_map"}
        own |= {"weights": [np.asarray(w).tolist() for w in self.weights], "x_mean": np.asarray(self.x_mean).tolist(),
                "x_std": np.asarray(self.x_std).tolist()}
        if self.feature_map is not None:
            own["feature_map"] = [type(self.feature_map).__name__, vars(self.feature_map)]
        return own

    @staticmethod
    def from_dict(own: dict) -> GradientModel:
        own = dict(own)
        if own.get("feature_map"):
            kind, params = own["feature_map"]
            own["feature_map"] = FEATURE_MAPS[kind](**params)
        return GradientModel(**own | {"weights": [np.array(w) for w in own["weights"]], "x_mean": np.array(own["x_mean"]),
                                      "x_std": np.array(own["x_std"])})
