"""Embedding whitening by a matrix-free block Jacobi-Davidson method.

Vectors are put on a grid (``floor(256 * c)``), so sums and squared deviations are exact integers.  The
covariance of the distinct grid vectors is never formed: it is only applied to a few vectors at a time, as
one pass over the distributed vectors (centre, multiply, sum).  The leading eigenvectors come from a small
search space: Rayleigh-Ritz within it, MINRES on the projected correction equation of every open pair (all
pairs share one pass a step), and locking of each pair whose residual is down to rounding.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollscope.llm.common import cut

GRID = 256
COMPONENTS = 4
GUARDS = 2              # further pairs followed, so that no leading one is overlooked
TOLERANCE = 1e-14       # residual of a locked pair, in units of the largest eigenvalue
GUARD_TOLERANCE = 1e-6  # the same for the guards, which are not returned
STALLED = 1e-11         # residuals below this that no longer shrink are down to rounding too
BASIS = 64              # columns of the search space before it is cut back
INNER = 6               # MINRES steps a correction
ROUNDS = 400
LEAST = 1e-12           # an eigenvalue below this share of the trace is a direction without variance
SEED = 11
_WIDE = 1 << 62


def _encoded(rows: np.ndarray) -> list[bytes]:
    """Each row's integers in the fewest of 2, 4 or 8 bytes: equal vectors have equal bytes."""
    top = np.abs(rows).max(1, initial=0)
    width = np.where(top <= 0x7FFF, 2, np.where(top <= 0x7FFFFFFF, 4, 8))
    return [r.astype(f"<i{w}").tobytes() for r, w in zip(rows, width)]


def _decoded(column: pa.Array, d: int) -> np.ndarray:
    """(rows, d) 64-bit integers of a column of `_encoded` vectors."""
    items = column.to_pylist()
    sizes = np.array([len(b) for b in items])
    out = np.empty((len(items), d), np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        out[at] = np.frombuffer(b"".join(items[i] for i in at), f"<i{size // d}").reshape(len(at), d)
    return out


def _grid_batches(d: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            vectors = part.column(1)
            whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False)
            part = part.filter(whole)
            values = part.column(1).flatten()
            with np.errstate(over="ignore", invalid="ignore"):  # null entries become NaN
                x = np.floor(GRID * values.to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, d)
            fine = (np.abs(x) < 9.2e18).all(1)  # false for NaN and infinities too
            x = x[fine].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).filter(pa.array(fine)), pa.array(_encoded(x), pa.binary())], ["vec_id", "x"])
    return run


def grid_vectors(vectors: DataFrame) -> tuple[DataFrame, int]:
    """((vec_id, x) of the usable rows, d); ``x`` holds the integers ``floor(256 * c)`` of a vector of length d.

    The table's length is its most common one (ties: the larger); a vector of another length lacks entries,
    or has some that others lack, and is dropped like one with a null entry. So is an entry beyond 64 bits.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("v"))
    sizes = rows.where("size(v) > 0").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    d = most["d"] if most else 1
    return rows.where(F.size("v") == d).mapInArrow(_grid_batches(d), "vec_id long, x binary"), d


def _exact_sums(d: int) -> Callable:
    """Per task: the sum of each dimension, of all squares (dim -1) and the number of vectors (dim -2), as integers."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares, n = [0] * d, 0, 0
        for part in parts:
            x = _decoded(part.column(0), d)
            top = int(np.abs(x).max(initial=0))
            x = x if top * top * x.size < _WIDE else x.astype(object)
            sums = [s + int(v) for s, v in zip(sums, x.sum(0))]
            squares += int((x * x).sum())
            n += len(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *range(d)], pa.int32()), pa.array([str(v) for v in (n, squares, *sums)])], ["dim", "v"])
    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums`` exactly: 64-bit integers where they fit, Python integers elsewhere."""
    bound = int(np.abs(x).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    if bound < _WIDE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` as doubles, rounded once from the exact integers."""
    return (deviations(x, n, sums) / n).astype(np.float64)


def squared_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The sum over dimensions of ``(n * x - sums) ** 2``, exactly; None where that passes 64 bits."""
    dev = deviations(x, n, sums)
    top = int(np.abs(dev).max(initial=0))
    if top * top * max(1, x.shape[1]) < _WIDE:
        return (dev * dev).sum(1).tolist()
    totals = [sum(int(v) ** 2 for v in row) for row in dev]
    return [t if t < 1 << 63 else None for t in totals]


def _matrix_sums(part_of: Callable, d: int, cols: int) -> Callable:
    """Per task: the sum over its vectors of the small matrices ``part_of`` makes of a batch, one row a matrix row."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            m = part_of(_decoded(part.column(0), d))
            total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total)), pa.int32()), *(pa.array(total[:, j]) for j in range(cols))],
                ["i", *(f"p{j}" for j in range(cols))])
    return run


def _summed(fit: DataFrame, part_of: Callable, d: int, rows: int, cols: int) -> np.ndarray:
    """The (rows, cols) matrix summed over all vectors; ``rows`` short rows reach the driver."""
    names = [f"p{j}" for j in range(cols)]
    parts = fit.mapInArrow(_matrix_sums(part_of, d, cols), "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((rows, cols))
    for r in parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def _orthonormal(z: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Orthonormal columns that add something of ``z`` to the columns of ``against``."""
    kept = against
    for column in z.T:
        size = np.linalg.norm(column)
        for _ in range(3):  # repeated until the projection takes nothing more away
            column = column - kept @ (kept.T @ column)
        left = np.linalg.norm(column)
        if left > 1e-8 * size and left > 0:
            kept = np.column_stack((kept, column / left))
    return kept[:, against.shape[1]:]


def corrections(product: Callable, shifts: np.ndarray, known: np.ndarray, rhs: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on (I - QQ')(A - shift I)(I - QQ') t = rhs, all columns in step so that a step is one pass."""
    def project(z):
        return z - known @ (known.T @ z)

    def unit(size):
        return np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)

    t = np.zeros_like(rhs)
    now = project(rhs)
    before = np.zeros_like(rhs)
    beta = np.linalg.norm(now, axis=0)
    start, rest, last_beta = beta.copy(), beta.copy(), np.zeros_like(beta)
    dbar, eps = np.zeros_like(beta), np.zeros_like(beta)
    cs, sn = -np.ones_like(beta), np.zeros_like(beta)
    w, older = np.zeros_like(rhs), np.zeros_like(rhs)
    for _ in range(steps):
        v = now * unit(beta)
        y = project(product(v) - v * shifts) - before * (beta * unit(last_beta))
        alpha = (v * y).sum(0)
        before, now = now, project(y - now * (alpha * unit(beta)))
        last_beta, beta = beta, np.linalg.norm(now, axis=0)
        delta, gbar = cs * dbar + sn * alpha, sn * dbar - cs * alpha
        old_eps, eps, dbar = eps, sn * beta, -cs * beta
        gamma = np.hypot(gbar, beta)
        cs, sn = gbar * unit(gamma), beta * unit(gamma)
        w, older = (v - older * old_eps - w * delta) * unit(gamma), w
        t = t + w * (cs * rest)
        rest = sn * rest
        if (rest <= 0.05 * start).all():
            break
    return t


def leading_pairs(product: Callable, d: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors of the symmetric matrix behind ``product``."""
    guards = min(GUARDS, d - k)
    empty = np.zeros((d, 0))
    basis = _orthonormal(np.random.default_rng(SEED).standard_normal((d, min(d, 2 * k))), empty)
    image, locked, values, lowest, stalled = product(basis), empty, [], math.inf, 0
    for _ in range(ROUNDS):
        small = basis.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(theta)[::-1]
        theta, basis, image = theta[order], basis @ turn[:, order], image @ turn[:, order]
        top = max([abs(theta[0]), *values]) if len(theta) else max(values)
        want = min(k + guards - len(values), basis.shape[1])
        residual = image[:, :want] - basis[:, :want] * theta[:want]
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        # rounding is reached where small residuals have stopped shrinking
        first = size[0] if want else 0.0
        stalled = stalled + 1 if first > 0.5 * lowest else 0
        lowest = min(lowest, first)
        whole = basis.shape[1] + len(values) == d
        limit = TOLERANCE * top if stalled < 3 else max(TOLERANCE, STALLED) * top
        done = 0
        while done < want and (whole or size[done] <= (limit if len(values) + done < k else GUARD_TOLERANCE * top)):
            done += 1
        if done:
            locked, values = np.column_stack((locked, basis[:, :done])), values + theta[:done].tolist()
            basis, image, lowest, stalled = basis[:, done:], image[:, done:], math.inf, 0
        if len(values) >= k + guards or not want:
            best = np.argsort(values)[::-1][:k]
            return np.array(values)[best], locked[:, best]
        open_ = want - done
        if basis.shape[1] + open_ > BASIS:
            basis, image = basis[:, :BASIS // 2], image[:, :BASIS // 2]
        known = np.column_stack((locked, basis[:, :open_]))
        t = corrections(product, theta[done:want], known, -residual[:, done:], INNER)
        new = _orthonormal(t, np.column_stack((locked, basis)))
        if not new.shape[1]:  # nothing new in the corrections: any direction not searched yet
            fresh = np.random.default_rng(SEED + len(values) + basis.shape[1]).standard_normal((d, 2))
            new = _orthonormal(fresh, np.column_stack((locked, basis)))
        basis, image = np.column_stack((basis, new)), np.column_stack((image, product(new)))
    raise RuntimeError(f"{len(values)} of {k} eigenpairs after {ROUNDS} rounds")


@dataclass
class Whitening:
    """A fitted whitening: a few numbers a dimension, whatever the number of vectors."""

    n: int                 # distinct grid vectors
    sums: list[int]        # of each dimension, exact
    values: np.ndarray     # eigenvalues of their covariance, falling; those without variance are left out
    axes: np.ndarray       # unit eigenvectors, one a column
    explained: np.ndarray  # eigenvalue over trace
    identity_error: float  # largest absolute entry of the whitened vectors' covariance minus the identity

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.axes / np.sqrt(self.values)


def fit(grid: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fit on each distinct vector of ``grid`` once; equal vectors fold map-side, so copies weigh nothing."""
    distinct = cut(grid.select("x").distinct(), "distinct")
    sums = distinct.mapInArrow(_exact_sums(d), "dim int, v string").groupBy("dim").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    told = {r["dim"]: int(r["v"]) for r in sums.collect()}  # d + 2 rows
    n, total = told.get(-2, 0), [told.get(j, 0) for j in range(d)]
    if not n:
        return Whitening(0, total, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0)
    trace = float(Fraction(n * told[-1] - sum(s * s for s in total), n * n))

    def product(z: np.ndarray) -> np.ndarray:
        def part_of(x):
            c = centred(x, n, total)
            return c.T @ (c @ z)
        return _summed(distinct, part_of, d, d, z.shape[1]) / n

    k = min(components, d) if trace > 0 else 0
    values, axes = leading_pairs(product, d, k) if k else (np.zeros(0), np.zeros((d, 0)))
    k = int((values > LEAST * trace).sum())
    found = Whitening(n, total, values[:k], axes[:, :k], values[:k] / trace if k else values, 0.0)
    if k:
        mean = _summed(distinct, lambda x: found.whiten(x).sum(0)[None, :], d, 1, k) / n

        def part_of(x):
            w = found.whiten(x) - mean
            return w.T @ w
        found.identity_error = float(np.abs(_summed(distinct, part_of, d, k, k) / n - np.eye(k)).max())
    return found


def _whitened_batches(found: Whitening, d: int) -> Callable:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = _decoded(part.column(1), d)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(squared_deviation(x, found.n, found.sums), pa.int64()),
                 pa.array(list(found.whiten(x)), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])
    return run


def whiten_vectors(vectors: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """((vec_id, deviation, whitened) of each usable row of ``vectors`` (vec_id, embedding), the fit).

    * Null vector, null or non-finite entry, entry beyond 64 bits on the grid, other length than the table's:
      the row is dropped. Null vec_ids and repeated rows are whitened like any other row.
    * Directions without variance have no component: ``whitened`` may be shorter than ``components``, and is
      empty where all vectors are equal. Equal eigenvalues: any orthonormal axes, the same for all rows.
    * ``deviation`` is exact; null where it passes 64 bits.
    * Other columns are ignored; an empty table gives no rows.

    The driver holds `components` + a search space of at most 64 columns of one vector's length.
    """
    grid, d = grid_vectors(vectors)
    grid = cut(grid, "grid")
    found = fit(grid, d, components)
    rows = grid.mapInArrow(_whitened_batches(found, d), "vec_id long, deviation long, whitened array<double>")
    return rows, found
