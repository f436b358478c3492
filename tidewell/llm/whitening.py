"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers, x = floor(64 * c) + 1000000, and each distinct x vector is one row of the fit list, which is written
down once. All sums over it are made by tasks and added up in a tree of tasks; the driver sees only what has the size of a
covariance, dimensions squared, whatever the number of rows.

The centred rows A = x - S/n are never written: a pass works on A R1^-1 R2^-1 …, by triangular solves with the factors found so
far. The first Gram matrix gets a small shift on its diagonal, so that its Cholesky factor exists for any condition of A;
further passes orthogonalise what it has left over, until the Gram matrix is the identity to rounding. R, the product of all factors, has A's singular
values and right vectors: its SVD gives the components and their eigenvalues without forming the covariance.
The last pass measures the covariance of the whitened rows.

Defined cases: rows whose vector is null or holds null or non-finite entries go; shorter vectors count as filled up with
zeros to the longest one's length; floor(64 * c) stays within ±2^52, where doubles are exact; repeated rows and null ids give
their rows again; an empty table, and vectors that are all empty, give no rows. Beyond the rank of the fit list a component has no variance: there ``whitened`` is null,
``explained`` is 0, and the identity is asked of the others only. All dimensions, n and a deviation are exact integers of any
size inside; a deviation beyond a long is null. Only the two named columns are read, so no other column can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

#: Scale and offset of the integers, and where floor(64 * c) stops.
SCALE, OFFSET, MOST = 64, 1_000_000, 1 << 52
COMPONENTS = 16
#: Gram passes at most; each divides the distance from the identity by orders of magnitude.
PASSES = 8
#: Distance of a Gram matrix from the identity (largest entry) up to which its own Cholesky factor makes the rows orthonormal
#: to rounding, so that no further pass is needed.
NEAR = 1e-3
#: Singular values below this share of the largest are rounding errors: no variance.
NULL = 1e-8
_ROWS_AT_ONCE = 4_000_000


def whole_numbers(vectors: Column) -> Column:
    """x of a vector of finite entries."""
    return F.transform(vectors, lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(c.cast("double") * SCALE))) + OFFSET)


def finite(vectors: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return vectors.isNotNull() & ~F.exists(vectors, bad)


def padded(x: Column, dims: int) -> Column:
    return F.when(F.size(x) < dims, F.concat(x, F.array_repeat(F.lit(OFFSET).cast("long"), F.lit(dims) - F.size(x)))).otherwise(x)


def _matrix(column, dims: int) -> np.ndarray:
    """An Arrow list column of int64 without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _blocks(batches: Iterator, dims: int, at: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        step = max(1, _ROWS_AT_ONCE // max(dims, 1))
        for i in range(0, batch.num_rows, step):
            yield _matrix(batch.column(at).slice(i, step), dims)


def minus_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: as int64 where that is safe, else as Python's integers."""
    most = max(int(np.abs(x).max(initial=0)), 1)
    if n * most < 1 << 62 and max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(centred: np.ndarray) -> list[int | None]:
    """Exact sum of squares of each row; None beyond a long."""
    if centred.dtype != object and int(np.abs(centred).max(initial=0)) ** 2 * max(centred.shape[1], 1) < 1 << 62:
        return (centred * centred).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (sum(int(c) * int(c) for c in row) for row in centred)]


def solve_right(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """rows @ inverse(upper), column by column (forward substitution over all rows at once)."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


@dataclass
class Moments:
    """Number, mean and centred products of some rows; ``add`` merges two of them."""

    n: int
    mean: np.ndarray
    products: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Moments:
        mean = rows.mean(axis=0) if len(rows) else np.zeros(rows.shape[1])
        low = rows - mean
        return cls(len(rows), mean, low.T @ low)

    def add(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        step = other.mean - self.mean
        return Moments(n, self.mean + step * (other.n / n), self.products + other.products + np.outer(step, step) * (self.n * other.n / n))

    def bytes(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.products.ravel()]).tobytes()

    @classmethod
    def read(cls, raw: bytes) -> Moments:
        v = np.frombuffer(raw)
        d = math.isqrt(len(v) - 1)  # d + d * d numbers
        return cls(int(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d))


def _summed(fit: DataFrame, dims: int, of: Callable[[np.ndarray], np.ndarray]) -> Moments | None:
    """Moments of ``of`` (rows to rows) over the fit list: by task, then by the root of as many tasks, then in the driver."""

    def parts(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = None
        for x in _blocks(batches, dims):
            got = Moments.of(of(x))
            total = got if total is None else total.add(got)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.bytes()], pa.binary())], ["part", "sums"])

    def tree(key, rows):
        import pyarrow as pa

        raw = [b for _, b in sorted(zip(rows.column("part").to_pylist(), rows.column("sums").to_pylist()))]
        total = Moments.read(raw[0])
        for r in raw[1:]:
            total = total.add(Moments.read(r))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "sums": pa.array([total.bytes()], pa.binary())})

    schema = "part long, sums binary"
    groups = max(1, math.isqrt(fit.rdd.getNumPartitions()))
    merged = fit.mapInArrow(parts, schema).groupBy((F.col("part") % groups).alias("group")).applyInArrow(tree, schema)
    total = None
    for r in merged.orderBy("part").collect():  # at most the root of the number of tasks
        got = Moments.read(r["sums"])
        total = got if total is None else total.add(got)
    return total


def _integer_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""

    def parts(batches):
        import pyarrow as pa

        n, sums = 0, [0] * dims
        for x in _blocks(batches, dims):
            low = x - OFFSET
            safe = int(np.abs(low).max(initial=0)) * max(len(low), 1) < 1 << 62
            got = (low if safe else low.astype(object)).sum(axis=0).tolist()
            sums, n = [a + b for a, b in zip(sums, got)], n + len(x)
        if n:
            from decimal import Decimal

            at = [-1, *range(dims)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([Decimal(v) for v in (n, *sums)], pa.decimal128(38, 0))], ["dim", "total"])

    rows = fit.mapInArrow(parts, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").cast("decimal(38,0)").alias("total"))
    found = {r["dim"]: int(r["total"]) for r in rows.collect()}  # a row for each dimension
    n = found.get(-1, 0)
    return n, [found.get(i, 0) + n * OFFSET for i in range(dims)]


@dataclass
class Whitening:
    """What a fit gives. Everything is of the size of the dimensions, or their square."""

    dims: int
    n: int
    sums: list[int]  # exact, of each dimension
    axes: np.ndarray  # dims x components, unit length
    eigenvalues: np.ndarray  # of the covariance with divisor n, falling
    trace: float
    rank: int
    identity_error: float
    passes: int

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Components of rows n * x - S; null ones are NaN."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(np.arange(self.axes.shape[1]) < self.rank, 1 / np.sqrt(self.eigenvalues), np.nan)
        return (centred.astype(float) / self.n) @ self.axes * scale


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of column ``x`` (array of long); None if there are none, or all are empty."""
    dims = vectors.agg(F.max(F.size("x"))).first()[0]
    if not dims:
        return None
    stored = Stored(vectors.select(padded(F.col("x"), dims).alias("x")).distinct(), "whitening")
    fit = stored.df
    n, sums = _integer_sums(fit, dims)
    factors: list[np.ndarray] = []

    def rows(x: np.ndarray) -> np.ndarray:
        a = minus_mean(x, n, sums).astype(float) / n
        for r in factors:
            a = solve_right(a, r)
        return a

    whole, rest, passes = np.eye(dims), np.eye(dims), 0
    unit = np.finfo(float).eps / 2
    while passes < PASSES:
        gram = _summed(fit, dims, rows).products
        passes += 1
        if passes == 1:
            # above the rounding errors of the product and of the factorisation, relative to the largest singular value
            shift = 11 * (n * dims + dims * (dims + 1)) * unit * np.linalg.norm(gram, 2)
            gram = gram + max(shift, np.finfo(float).tiny * 1e30) * np.eye(dims)
        try:
            r = np.linalg.cholesky(gram).T
            if passes > 1 and np.diag(r).min() < 1e-3 * np.diag(r).max():
                raise np.linalg.LinAlgError  # positive by chance
        except np.linalg.LinAlgError:
            rest = gram  # fewer independent directions than dimensions: more passes can't make these rows a basis
            break
        factors = [*factors, r]
        whole = r @ whole
        if passes > 1 and np.abs(gram - np.eye(dims)).max() < NEAR:
            break
    # what is left over beside the factors: the identity, but where directions have no variance
    g, u = np.linalg.eigh(rest)
    _, sigma, vt = np.linalg.svd((np.sqrt(np.maximum(g, 0))[:, None] * u.T) @ whole)
    trace = float((sigma**2).sum()) / n
    sigma, axes = sigma[:components], vt[:components].T
    found = Whitening(dims, n, sums, axes, sigma**2 / n, trace, int((sigma > NULL * sigma[:1]).sum()), 0.0, passes)
    if found.rank:
        got = _summed(fit, dims, lambda x: found.whitened(minus_mean(x, n, sums))[:, : found.rank])
        found.identity_error = float(np.abs(got.products / n - np.eye(found.rank)).max())
    stored.drop()
    return found


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(finite(F.col("v"))).select("vec_id", whole_numbers(F.col("v")).alias("x"))
    model = fit_whitening(rows.select("x"), components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    share = [e / model.trace if i < model.rank else 0.0 for i, e in enumerate(model.eigenvalues.tolist())]
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # dimensions times components numbers

    def run(batches):
        import pyarrow as pa

        m = shared.value
        k = m.axes.shape[1]
        for batch in batches:
            step = max(1, _ROWS_AT_ONCE // max(m.dims, k, 1))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                centred = minus_mean(_matrix(part.column(1), m.dims), m.n, m.sums)
                size = part.num_rows
                at = pa.array(np.repeat(np.arange(size), k))
                white = m.whitened(centred).ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at),
                        pa.array(np.tile(np.arange(1, k + 1), size), pa.int32()),
                        pa.array(np.full(size * k, m.n), pa.int64()),
                        pa.array(squares(centred), pa.int64()).take(at),
                        pa.array(white, pa.float64(), mask=np.isnan(white)),
                        pa.array(np.tile(share, size), pa.float64()),
                        pa.array(np.full(size * k, m.identity_error), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", padded(F.col("x"), model.dims).alias("x")).mapInArrow(run, schema)
