"""Embedding whitening: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

The scatter is A = R'R (rows and columns in pivot order) with R upper triangular, of as many rows as A has rank.
One-sided Jacobi rotates the columns of R' until they are orthogonal: their squared norms are A's eigenvalues,
the normalised columns its eigenvectors. A itself is not squared again, so small eigenvalues keep their digits.

Passes over the table: count and exact sums; the centred scatter; the covariance of the whitened rows; the
output. A task holds one Arrow batch and sums of width² at most; partial sums are added by Spark, a row of
the matrix each, and only finished sums (width² numbers a vector length) reach the driver.

Rules: vectors that are null or hold null or non-finite entries are dropped; repeated rows and ids count each.
Vectors of another length are a fit of their own. Empty vectors have no components, and rank r gives r
components at most (one vector, or equal ones: none). An entry whose long overflows, or a deviation that does, is an error. Columns of
any name may stand beside; only the id and the vector are read, a null id stays null. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, batch

#: How a vector's entry becomes a long.
SCALE, SHIFT = 1024.0, 100_000
#: Residual variance of a pivot below this share of the largest ends the factor.
RANK = 1e-12


def longs_of(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, width, x): the longs of each vector without null or non-finite entries."""
    e = F.col(f"`{vector}`")
    finite = F.forall(e, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform(e, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    small = F.forall(e, lambda c: F.abs(c.cast("double")) < float(1 << 50))
    x = F.when(small, x).otherwise(F.raise_error(F.lit("a vector's entry is too large for a long")))
    return df.filter(e.isNotNull() & finite).select(F.col(f"`{vec_id}`").alias("vec_id"), F.size(e).alias("width"), x.alias("x"))


def _rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, row numbers, matrix of longs) for each vector length in a batch, in bounded pieces."""
    widths = np.asarray(b.column("width").to_numpy(zero_copy_only=False))
    col = b.column("x")
    off = np.asarray(col.offsets.to_numpy())
    flat = np.asarray(col.values.to_numpy(zero_copy_only=False), np.int64)
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        step = max(1, SLICE_BYTES // (8 * max(w, 1)))
        for lo in range(0, len(at), step):
            k = at[lo:lo + step]
            yield w, k, flat[off[k][:, None] + np.arange(w)]


def _summed(df: DataFrame, partial: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
    """Sum of ``partial(x, width)``, a matrix, over all rows by vector length; a matrix row is a Spark row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for w, _, x in _rows(b):
                m = partial(x, w)
                total[w] = total[w] + m if w in total else m
        for w, m in total.items():
            yield batch(["width", "line", "v"], [np.full(len(m), w, np.int32), np.arange(len(m), dtype=np.int32),
                                                 pa.array(list(m), pa.list_(pa.float64()))])

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            m = np.vstack([np.asarray(v) for v in b.column("v").to_pylist()]).sum(0)
            total = m if total is None else total + m
        yield batch(["width", "line", "v"], [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()),
                                             pa.array([total], pa.list_(pa.float64()))])

    schema = "width int, line int, v array<double>"
    rows = df.mapInArrow(task, schema).groupBy("width", "line").applyInArrow(add, schema).orderBy("width", "line").toArrow()
    out: dict[int, list[np.ndarray]] = {}
    for w, v in zip(rows["width"].to_pylist(), rows["v"].to_pylist()):
        out.setdefault(w, []).append(np.asarray(v, np.float64))
    return {w: np.vstack(v) for w, v in out.items()}


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R upper triangular in pivot order and the order: a[order][:, order] = R'R. R has rank(a) rows."""
    a, d = np.array(a, np.float64), len(a)
    order, r = np.arange(d), np.zeros((d, d))
    largest = max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        rest = a.diagonal()[k:]
        p = k + int(np.argmax(rest))
        if a[p, p] <= RANK * largest or a[p, p] <= 0:
            return r[:k], order
        for m in (a, a.T, r.T):
            m[[k, p]] = m[[p, k]]
        order[[k, p]] = order[[p, k]]
        r[k, k] = np.sqrt(a[k, k])
        r[k, k + 1:] = a[k, k + 1:] / r[k, k]
        a[k + 1:, k + 1:] -= np.outer(r[k, k + 1:], r[k, k + 1:])
    return r, order


def one_sided_jacobi(m: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``m`` with its columns rotated until they are orthogonal to double precision."""
    m = np.array(m, np.float64)
    n = m.shape[1]
    ring = list(range(n + n % 2))
    for _ in range(sweeps):
        turned = 0
        for _ in range(len(ring) - 1):     # each round rotates disjoint pairs; all pairs meet in a sweep
            pairs = [(i, j) for i, j in zip(ring[:len(ring) // 2], ring[::-1]) if i < n and j < n]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            i, j = np.array(pairs).T
            a, b = m[:, i], m[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > 1e-15 * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned += int(turn.sum())
            i, j, a, b, aa, bb, ab = i[turn], j[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
            z = (bb - aa) / (2 * ab)
            t = np.where(z < 0, -1.0, 1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            m[:, i], m[:, j] = c * (a - t * b), c * (b + t * a)
        if not turned:
            break
    return m


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and unit eigenvectors as columns; as many as the rank of ``a``."""
    r, order = pivoted_cholesky(a)
    if not len(r):
        return np.zeros(0), np.zeros((len(a), 0))
    m = one_sided_jacobi(r.T)
    norms = np.sqrt((m * m).sum(0))
    rank = np.argsort(-norms, kind="stable")
    vectors = np.zeros((len(a), len(norms)))
    vectors[order] = m[:, rank] / norms[rank]
    lead = np.abs(vectors).argmax(0)       # one sign for reruns
    vectors *= np.where(vectors[lead, np.arange(len(norms))] < 0, -1.0, 1.0)
    return norms[rank] ** 2, vectors


@dataclass
class Fit:
    """One vector length: rows, exact sums, variances, components as columns, total variance, whitening error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n; the whole part of the mean leaves as an integer."""
        whole = [s // self.n for s in self.sums]
        part = np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return (x - np.array(whole, np.int64)) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sum of (n x - S)² of each row; by Python's integers where int64 could overflow."""
        whole = [s // self.n for s in self.sums]
        rest = [s - w * self.n for s, w in zip(self.sums, whole)]
        d = x - np.array(whole, np.int64)
        if d.size and (int(np.abs(d).max()) + 1) ** 2 * self.n ** 2 * x.shape[1] >= 1 << 62:
            return [sum((self.n * int(v) - r) ** 2 for v, r in zip(row, rest)) for row in d]
        return ((d * self.n - np.array(rest, np.int64)) ** 2).sum(1).tolist()


def fit(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> dict[int, Fit]:
    """The whitening of each vector length, from all rows."""
    x = longs_of(df, vec_id, vector)
    sums = x.select("width", F.posexplode_outer("x").alias("at", "v")).groupBy("width", "at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("s")).collect()
    by_width: dict[int, list] = {}
    for row in sorted(sums, key=lambda row: (row["width"], -1 if row["at"] is None else row["at"])):
        by_width.setdefault(row["width"], []).append(row)
    fits = {w: Fit(rows[0]["n"], [row["s"] for row in rows][:w], np.zeros(0), np.zeros((w, 0)), 0.0) for w, rows in by_width.items()}
    fits = {w: f for w, f in fits.items() if w}
    x = x.filter("width > 0")

    def scatter(m: np.ndarray, w: int) -> np.ndarray:
        c = fits[w].centred(m)
        return c.T @ c

    if not fits:
        return fits
    for w, a in _summed(x, scatter).items():
        f = fits[w]
        values, vectors = eigen((a + a.T) / 2)
        f.values, f.vectors, f.trace = values[:components] / f.n, vectors[:, :components], float(np.trace(a)) / f.n

    def moments(m: np.ndarray, w: int) -> np.ndarray:
        y = fits[w].whitened(m)
        return np.vstack([y.sum(0), y.T @ y]) if y.shape[1] else np.zeros((1, 0))

    for w, m in _summed(x, moments).items():
        f = fits[w]
        if m.shape[1]:                     # the rows are centred already; their mean is a rounding error
            mean = m[0] / f.n
            f.identity_error = float(np.abs(m[1:] / f.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def whiten(df: DataFrame, components: int = 8, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    fits = fit(df, components, vec_id, vector)
    kind = next(t for c, t in df.dtypes if c == vec_id)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, at, x in _rows(b):
                f = fits[w]
                k = len(f.values)
                if not k:
                    continue
                dev = f.deviation(x)
                ids = b.column("vec_id").take(pa.array(np.repeat(at, k)))
                n = len(at) * k
                yield batch(names, [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), np.full(n, f.n, np.int64),
                                    pa.array([d for d in dev for _ in range(k)], pa.int64()), f.whitened(x).ravel(),
                                    np.tile(f.values / f.trace, len(at)), np.full(n, f.identity_error)])

    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return longs_of(df, vec_id, vector).filter("width > 0").mapInArrow(task, schema)
