"""Sums over all pairs of columns without a row per pair.

A task turns its Arrow batches into a matrix of standardised values (missing: 0) and a matrix of what is
present, and matrix products give the sums of every pair at once; a row is not multiplied by the number of
pairs. Partial sums leave a task as one row per (segment, pair), or earlier when the sums held for many segments
reach :data:`HELD_BYTES`, and Spark adds them. Values are centred on the segment's own mean beforehand, in the
JVM, so that sums of products keep their digits and partial sums can simply be added.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import long_numeric, num
from .joins import keyed_join, lookup_join
from ..session import materialize

#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Sums of a pair (i, j): rows with both, powers of i's and of j's values over them, and products.
ORDER_2 = ("n", "a1", "a2", "b1", "b2", "ab")
ORDER_4 = (*ORDER_2, "a3", "a4", "b3", "b4", "aab", "abb")


def centres(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by..., _mu, _sd, _n``: mean, sample deviation and count of each column, in the columns' order."""
    st = long_numeric(df, cols, by, keep_nulls=True).groupBy(*by, "column").agg(
        F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n"),
        (F.min("value") < F.max("value")).alias("varied"))
    at = {c: F.element_at("_of", F.lit(c)) for c in cols}
    st = st.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("m", "s", "n", "varied")))).alias("_of"))
    return st.select(*by, F.array(*[at[c]["m"] for c in cols]).alias("_mu"),
                     F.array(*[F.when(at[c]["varied"], at[c]["s"]).otherwise(0.0) for c in cols]).alias("_sd"),
                     F.array(*[F.coalesce(at[c]["n"], F.lit(0)) for c in cols]).alias("_n"))


def standardised(df: DataFrame, cols: Sequence[str], by: Sequence[str], centre: DataFrame, *extra: Column) -> DataFrame:
    """``by..., _z`` (and ``extra``): (value - mean) / deviation of each column; 0 for a constant column, null for missing."""
    rows = lookup_join(df.select(*by, *[num(c).alias(f"_x{i}") for i, c in enumerate(cols)]), centre, by)
    z = [F.when(F.col(f"_x{i}").isNotNull(), F.coalesce(F.try_divide(F.col(f"_x{i}") - F.col("_mu")[i], F.col("_sd")[i]), F.lit(0.0)))
         for i in range(len(cols))]
    return rows.select(*by, F.array(*z).alias("_z"), *extra)


def raw_rows(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``by..., _x0, _x1, ..``: the columns as doubles, NaN and infinities still in them. :func:`cleaned` reads them inside
    a task, which spares the JVM an expression per column (of a wide table too large a method to be compiled)."""
    return df.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])


def cleaned(b: pa.RecordBatch, width: int) -> np.ndarray:
    """The values of a batch of :func:`raw_rows` as a matrix; what is missing, NaN or infinite is NaN."""
    m = np.empty((width, b.num_rows)).T
    for i in range(width):
        m[:, i] = b.column(f"_x{i}").to_numpy(zero_copy_only=False)
    m[np.isinf(m)] = np.nan
    return m


def wide_centres(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """:func:`centres` for wide tables: tasks reduce their batches to a row per (segment, column), none per value.

    Deviations are taken from each batch's own mean and joined by the distances of the means, so that they keep their digits.
    """
    by = list(by)
    width = len(cols)
    names = ("there", "n", "mean", "m2", "lo", "hi")
    every = np.arange(width)[:, None]

    def work(b: pa.RecordBatch) -> Callable[[np.ndarray], np.ndarray]:
        full = cleaned(b, width)

        def of(at: np.ndarray) -> np.ndarray:
            v = full[at] if len(at) < len(full) else full
            here = ~np.isnan(v)
            n = here.sum(0).astype(np.float64)
            mean = np.where(here, v, 0.0).sum(0) / np.maximum(n, 1.0)
            d = np.where(here, v - mean, 0.0)
            return np.stack([np.ones(width), n, mean, (d * d).sum(0), np.where(here, v, np.inf).min(0), np.where(here, v, -np.inf).max(0)], 1)
        return of

    def join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = x[:, 1] + y[:, 1]
        share = y[:, 1] / np.maximum(n, 1.0)
        gap = y[:, 2] - x[:, 2]
        return np.stack([x[:, 0], n, x[:, 2] + gap * share, x[:, 3] + y[:, 3] + gap * gap * x[:, 1] * share,
                         np.minimum(x[:, 4], y[:, 4]), np.maximum(x[:, 5], y[:, 5])], 1)

    part = materialize(partial_sums(raw_rows(df, cols, by), by, names, 1, work, every, join))
    keys = [*by, "k0"]
    mean = part.groupBy(*keys).agg(F.sum("n").alias("_all"), F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("m"))
    st = keyed_join(part, mean, keys).groupBy(*keys, "_all", "m").agg(
        F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("m")) ** 2).alias("ss"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    entry = F.struct("k0", "m", F.sqrt(F.try_divide(F.col("ss"), F.col("_all") - 1)).alias("s"), F.col("_all").cast("long").alias("n"),
                     (F.col("lo") < F.col("hi")).alias("varied"))
    st = st.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_of"))
    return st.select(*by, F.col("_of.m").alias("_mu"), F.transform("_of", lambda e: F.when(e["varied"], e["s"]).otherwise(0.0)).alias("_sd"),
                     F.col("_of.n").alias("_n"))


def _segments(b: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """(key, row numbers) of each segment in a batch."""
    if not by:
        yield (), np.arange(b.num_rows)
        return
    code = np.zeros(b.num_rows, np.int64)
    for c in by:
        d = b.column(c).dictionary_encode(null_encoding="encode")
        code = code * (len(d.dictionary) + 1) + np.asarray(d.indices.fill_null(len(d.dictionary)), np.int64)
        _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        yield tuple(b.column(c)[int(rows[0])].as_py() for c in by), rows


def matrix(col: pa.Array, width: int, dtype=np.float64) -> np.ndarray:
    """A column of arrays of one length as a matrix; null is NaN."""
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype).reshape(-1, width)


def partial_sums(rows: DataFrame, by: Sequence[str], names: Sequence[str], n_keys: int,
                 work: Callable[[pa.RecordBatch], Callable[[np.ndarray], np.ndarray]], keys: np.ndarray,
                 join: Callable[[np.ndarray, np.ndarray], np.ndarray] = np.add) -> DataFrame:
    """``by..., k0, k1, .., names...``: per task and segment what ``work`` gives for its rows of a batch, a matrix of
    (key row, name), put together by ``join``. ``keys`` are the integer keys of the key rows; rows whose first sum is 0
    are left out."""
    by = list(by)
    types = {c: next(t for n, t in rows.dtypes if n == c) for c in by}
    schema = "".join(f"`{c}` {t}, " for c, t in types.items()) + "".join(f"k{i} int, " for i in range(n_keys)) \
        + ", ".join(f"{n} double" for n in names)
    labels = [*by, *[f"k{i}" for i in range(n_keys)], *names]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: dict[str, pa.DataType] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for key, m in held.items():
                some = m[:, 0] != 0
                k, m = keys[some], m[some]
                if len(m):
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array([v] * len(m), kinds[c]) for c, v in zip(by, key)],
                         *[pa.array(k[:, i], pa.int32()) for i in range(n_keys)],
                         *[pa.array(np.ascontiguousarray(m[:, i])) for i in range(len(names))]], labels)
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            kinds = {c: b.column(c).type for c in by}
            of = work(b)
            for key, at in _segments(b, by):
                m = of(at)
                held[key] = join(held[key], m) if key in held else m
            if sum(m.nbytes for m in held.values()) > HELD_BYTES:
                yield from emit()
        yield from emit()

    return rows.mapInArrow(task, schema)


def summed(rows: DataFrame, by: Sequence[str], names: Sequence[str], n_keys: int,
           work: Callable[[pa.RecordBatch], Callable[[np.ndarray], np.ndarray]],
           keys: np.ndarray) -> DataFrame:
    """:func:`partial_sums` added up: ``by..., k0, k1, .., names...``."""
    by = list(by)
    part = partial_sums(rows, by, names, n_keys, work, keys)
    return part.groupBy(*by, *[f"k{i}" for i in range(n_keys)]).agg(*[F.sum(n).alias(n) for n in names])


def _scaled(b: pa.RecordBatch, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """As :func:`standardised`, of a batch of :func:`raw_rows`."""
    m = cleaned(b, len(mu))
    here = ~np.isnan(m)
    with np.errstate(all="ignore"):
        z = (m - mu) / sd
    z[np.isnan(z) | (sd == 0)] = 0.0
    return np.where(here, z, np.nan)


def pair_sums(z: DataFrame, width: int, by: Sequence[str] = (), fourth: bool = False,
              centre: tuple[Sequence[float], Sequence[float]] | None = None) -> DataFrame:
    """``by..., k0, k1`` (i < j) and the sums :data:`ORDER_2` or :data:`ORDER_4` over the rows that have both, from
    :func:`standardised` rows, or from :func:`raw_rows` if ``centre`` has the means and deviations of the columns."""
    names = ORDER_4 if fourth else ORDER_2
    i, j = np.triu_indices(width, 1)
    mu, sd = (np.array([np.nan if x is None else x for x in c], float) for c in centre or ((), ()))

    def work(b: pa.RecordBatch) -> Callable[[np.ndarray], np.ndarray]:
        full = _scaled(b, mu, sd) if centre else matrix(b.column("_z"), width)

        def of(at: np.ndarray) -> np.ndarray:
            v = full[at] if len(at) < len(full) else full
            here = ~np.isnan(v)
            m, v = here.astype(np.float64), np.where(here, v, 0.0)
            p = [m, v, v * v]
            if fourth:
                p += [p[2] * v, p[2] * p[2]]
            # [i, j]: sum of a power of i over the rows that have j
            over = [np.broadcast_to(x.sum(0)[:, None], (width, width)) for x in p] if here.all() else [x.T @ m for x in p]
            out = [over[0][i, j], over[1][i, j], over[2][i, j], over[1][j, i], over[2][j, i], (v.T @ v)[i, j]]
            if fourth:
                square = p[2].T @ v
                out += [over[3][i, j], over[4][i, j], over[3][j, i], over[4][j, i], square[i, j], square[j, i]]
            return np.stack(out, 1)
        return of

    return summed(z, by, names, 2, work, np.stack([i, j], 1)).withColumn("n", F.col("n").cast("long"))


def bin_sums(rows: DataFrame, width: int, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """``by..., k0`` (feature), ``k1`` (bin from 1), ``k2`` (target), ``n, s1, s2``: count, sum and sum of squares of
    each target's standardised values in each bin of each feature. ``rows``: ``_z`` and ``_bin``, 0 for no bin."""
    f, b_, t = (x.ravel() for x in np.meshgrid(np.arange(width), np.arange(1, bins + 1), np.arange(width), indexing="ij"))

    def work(b: pa.RecordBatch) -> Callable[[np.ndarray], np.ndarray]:
        full, codes = matrix(b.column("_z"), width), matrix(b.column("_bin"), width)

        def of(at: np.ndarray) -> np.ndarray:
            v, c = full[at], codes[at]
            here = ~np.isnan(v)
            m, v = here.astype(np.float64), np.where(here, v, 0.0)
            right = np.concatenate([m, v, v * v], 1)
            one = (c[:, :, None] == np.arange(1, bins + 1)).reshape(len(c), -1).astype(np.float64)
            sums = (one.T @ right).reshape(width * bins, 3, width)
            return sums.transpose(0, 2, 1).reshape(-1, 3)
        return of

    return summed(rows, by, ("n", "s1", "s2"), 3, work, np.stack([f, b_, t], 1)).withColumn("n", F.col("n").cast("long"))
