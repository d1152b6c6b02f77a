"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation,
bisection on Sturm counts, inverse iteration with reorthogonalisation."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues closer than this share of the matrix's norm form a cluster,
#: whose vectors are made orthogonal to each other.
CLUSTER_GAP = 1e-3


def tridiagonalise(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(diagonal, off-diagonal, reflectors): the product of the reflectors
    ``I - 2 v v'`` (each from its row on) turns the matrix tridiagonal."""
    a = np.array(matrix, float)
    reflectors = []
    for k in range(len(a) - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if not size:
            continue
        x[0] += np.copysign(size, x[0])
        v = x / np.linalg.norm(x)
        block = a[k + 1:, k + 1:]
        p = 2 * (block @ v)
        w = p - (v @ p) * v
        block -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        reflectors.append((k + 1, v))
    return np.diagonal(a).copy(), np.diagonal(a, -1).copy(), reflectors


def sturm_count(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each value of ``at``: the negative pivots
    of the factorisation of T - at."""
    tiny = np.finfo(float).tiny / EPS * max(1.0, float((off ** 2).max(initial=0)))
    q, below = diagonal[0] - at, np.zeros(len(at), int)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - at - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection of all at once."""
    n = len(diagonal)
    reach = np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    margin = EPS * n * (np.abs(diagonal) + reach).max()
    low, high = np.full(k, (diagonal - reach).min() - margin), np.full(k, (diagonal + reach).max() + margin)
    rank = n - np.arange(k)  # so many eigenvalues are not above the one sought
    for _ in range(2100):  # ends by the width long before
        mid = low + (high - low) / 2
        if ((mid <= low) | (mid >= high)).all():
            break
        under = sturm_count(diagonal, off, mid) >= rank
        low, high = np.where(under, low, mid), np.where(under, mid, high)
    return low + (high - low) / 2


def solve_shifted(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - shift) z = right, elimination with row exchanges."""
    n = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    b = right.tolist()
    for i in range(n - 1):
        under = float(off[i])
        if abs(under) > abs(main[i]):  # the next row becomes this one
            main[i], upper[i], second[i], main[i + 1], upper[i + 1], b[i], b[i + 1], under = (
                under, main[i + 1], upper[i + 1], upper[i], 0.0, b[i + 1], b[i], main[i])
        if abs(main[i]) < tiny:
            main[i] = tiny
        factor = under / main[i]
        main[i + 1] -= factor * upper[i]
        upper[i + 1] -= factor * second[i]
        b[i + 1] -= factor * b[i]
    if abs(main[-1]) < tiny:
        main[-1] = tiny
    for i in reversed(range(n)):
        if i + 1 < n:
            b[i] -= upper[i] * b[i + 1]
        if i + 2 < n:
            b[i] -= second[i] * b[i + 2]
        b[i] /= main[i]
    return np.array(b)


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``k`` largest eigenvalues, falling, and unit
    eigenvectors as columns, orthogonal also where eigenvalues are equal."""
    n = len(matrix)
    k = min(k, n)
    scale = float(np.abs(matrix).max(initial=0.0))
    if not k or not scale:
        return np.zeros(k), np.eye(n)[:, :k]
    diagonal, off, reflectors = tridiagonalise(np.asarray(matrix, float) / scale)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max(initial=0.0))
    tiny, gap = EPS * norm, CLUSTER_GAP * norm
    rng = np.random.default_rng(11)
    vectors, cluster, last = np.zeros((n, k)), 0, np.inf
    for j in range(k):
        if j and values[j - 1] - values[j] > gap:
            cluster = j
        # equal values get shifts a little apart, so that the solutions differ
        shift = min(values[j], last - 10 * tiny) if j > cluster else values[j]
        last = shift
        z = rng.uniform(-1, 1, n)
        for _ in range(6):
            z = solve_shifted(diagonal, off, shift, z / np.linalg.norm(z), tiny)
            z /= np.abs(z).max()
            for _ in range(2):
                z -= vectors[:, cluster:j] @ (vectors[:, cluster:j].T @ z)
        vectors[:, j] = z / np.linalg.norm(z)
    for first, v in reversed(reflectors):
        vectors[first:] -= 2 * np.outer(v, v @ vectors[first:])
    return values * scale, vectors / np.linalg.norm(vectors, axis=0)
