"""A24 - derived columns: t = a*b, a+b, a-b or b-a (within 2 %) on > 95 % of rows.

The matches of each (target, pair) candidate are counted inside the scan stage, so only one small
buffer per (partition, candidate) is shuffled. The candidates are cubic in the columns; those that no
row can match are left out beforehand by the columns' ranges (exact). Of many candidates most are
refuted on a part of the rows, by an exact bound, and only the survivors are counted on all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tiles
from ..functions.columns import as_list, num, numeric_columns
from ..functions.joins import keyed_join

RELATIVE_TOLERANCE = 0.02
MIN_VALID_ROWS = 3
MATCH_SHARE = 0.95
#: Candidates up to which all are counted on all rows at once, by the JVM.
REFUTE_FROM = 400
#: Parts of the rows, in percent, on which candidates are refuted one after another; over 5 to refute any.
REFUTE_PERCENT = (8, 25)
#: Rows that numpy looks at together.
ROWS_TOGETHER = 2048
FORMS = ("product", "sum", "difference", "reverse_difference")


def _reachable(ranges: list[tuple[float, float] | None]) -> list[tuple[int, int, int]]:
    """(target, a, b) of which some form of a and b can come within the tolerance of the target's range."""
    out = []
    for t, span in enumerate(ranges):
        if span is None:
            continue
        lo, hi = span
        slack = RELATIVE_TOLERANCE * max(abs(lo), abs(hi)) + 1e-9
        for i, j in combinations([k for k in range(len(ranges)) if k != t], 2):
            if ranges[i] is None or ranges[j] is None:
                continue
            (a0, a1), (b0, b1) = ranges[i], ranges[j]
            products = (a0 * b0, a0 * b1, a1 * b0, a1 * b1)
            spans = [(min(products), max(products)), (a0 + b0, a1 + b1), (a0 - b1, a1 - b0), (b0 - a1, b1 - a0)]
            if any(s0 <= hi + slack and s1 >= lo - slack for s0, s1 in spans):
                out.append((t, i, j))
    return out


def derived_counters(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """``by..., target, col_a, col_b, valid, product, sum, difference, reverse_difference`` counts of the
    candidates that the ranges allow; the others match on no row."""
    by = as_list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    clean, trip = _candidates(df, cols, by)
    if not trip:
        return _no_counters(df, by)
    return _counted(clean, cols, by, trip)


def _no_counters(df: DataFrame, by: list[str]) -> DataFrame:
    kinds = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
    return df.sparkSession.createDataFrame(
        [], kinds + "target string, col_a string, col_b string, valid long, product long, sum long, "
                    "difference long, reverse_difference long")


def _candidates(df: DataFrame, cols: list[str], by: list[str]) -> tuple[DataFrame, list[tuple[int, int, int]]]:
    """The cleaned columns and the (target, a, b) that the columns' ranges over all rows allow."""
    clean = df.select(*by, *[num(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    ends = clean.agg(*[f(f"_c{i}").alias(f"{k}{i}") for i in range(len(cols)) for k, f in (("lo", F.min), ("hi", F.max))]).first() \
        if cols else None
    trip = _reachable([(ends[f"lo{i}"], ends[f"hi{i}"]) if ends[f"lo{i}"] is not None else None for i in range(len(cols))])
    return clean, trip


def _counted(clean: DataFrame, cols: list[str], by: list[str], trip: list[tuple[int, int, int]]) -> DataFrame:
    """Counts of the candidates, named. A few are counted in the scan stage by the JVM, many by numpy."""
    names = F.array(*[F.lit(c) for c in cols])
    counts = (_counted_wide if len(trip) > REFUTE_FROM else _counted_rows)(clean, cols, by, trip)
    return counts.select(*by, names[F.col("t")].alias("target"), names[F.col("a")].alias("col_a"), names[F.col("b")].alias("col_b"),
                         "valid", *FORMS)


def _counted_rows(clean: DataFrame, cols: list[str], by: list[str], trip: list[tuple[int, int, int]]) -> DataFrame:
    index = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("a"), F.lit(j).alias("b")) for t, i, j in trip]))
    rows = clean.select(*by, F.array(*[f"_c{i}" for i in range(len(cols))]).alias("_v")).select(*by, "_v", index.alias("_p"))
    v = F.col("_v")
    rows = rows.select(*by, "_p.*", v[F.col("_p.t")].alias("_t"), v[F.col("_p.a")].alias("_a"), v[F.col("_p.b")].alias("_b"))
    scale = F.greatest(F.abs("_t"), F.lit(1e-9))
    forms = (F.col("_a") * F.col("_b"), F.col("_a") + F.col("_b"), F.col("_a") - F.col("_b"), F.col("_b") - F.col("_a"))
    return rows.where("_t IS NOT NULL AND _a IS NOT NULL AND _b IS NOT NULL").groupBy(*by, "t", "a", "b").agg(
        F.count(F.lit(1)).alias("valid"),
        *[F.count(F.when(F.abs(F.col("_t") - x) / scale < RELATIVE_TOLERANCE, 1)).alias(f) for f, x in zip(FORMS, forms)])


def derived_relationships(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Matching (target, a, b, form) rows and the derived pairs they imply.

    Returns ``by..., target, col_a, col_b, form, match_share`` for every form that
    matches; ``derived_pairs`` turns it into the unordered pair set. Many candidates are
    refuted first (:func:`_survivors`) and only the survivors counted on all rows.
    """
    by = as_list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    clean, trip = _candidates(df, cols, by)
    if not by and len(trip) > REFUTE_FROM:
        trip = _survivors(clean, cols, trip)
    c = _counted(clean, cols, by, trip) if trip else _no_counters(df, by)
    forms = F.array(*[F.struct(F.lit(f).alias("form"), (F.col(f) / F.col("valid")).alias("match_share"))
                      for f in FORMS])
    out = c.where(F.col("valid") >= MIN_VALID_ROWS).select(*by, "target", "col_a", "col_b", F.explode(forms).alias("_f"))
    return out.select(*by, "target", "col_a", "col_b", "_f.form", "_f.match_share").where(F.col("match_share") > MATCH_SHARE)


def _survivors(clean: DataFrame, cols: list[str], trip: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that can still match on more than 95 % of their valid rows.

    Mismatches on a part of the rows are mismatches of the whole: once every form of a candidate has at least 5 % of
    all rows against it, it is out, whatever the other rows hold (its valid rows are no more than all rows). The
    parts are classes of a hash of the row.
    """
    n_rows = clean.count()
    at = F.pmod(F.xxhash64(*clean.columns), F.lit(100))
    for percent in REFUTE_PERCENT:
        if len(trip) <= REFUTE_FROM:
            break
        counts = _counted_wide(clean.where(at < percent), cols, [], trip)
        bad = F.col("valid") - F.greatest(*FORMS)
        out = {(r["t"], r["a"], r["b"]) for r in counts.where(bad >= (1 - MATCH_SHARE) * n_rows).select("t", "a", "b").collect()}
        trip = [t for t in trip if t not in out]                # at most all candidates: a matter of the columns alone
    return trip


def _counted_wide(clean: DataFrame, cols: list[str], by: list[str], trip: list[tuple[int, int, int]]) -> DataFrame:
    """``by..., t, a, b, valid`` and the matches of each form, counted for many candidates by numpy: a pair's four forms
    are made once and held against all its targets."""
    of_pair: dict[tuple[int, int], list[int]] = {}
    for t, i, j in trip:
        of_pair.setdefault((i, j), []).append(t)
    pairs = [(i, j, np.array(ts)) for (i, j), ts in of_pair.items()]
    keys = np.array([(t, i, j) for i, j, ts in pairs for t in ts.tolist()], np.int32)
    width = len(cols)

    def work(b: pa.RecordBatch) -> Callable[[np.ndarray], np.ndarray]:
        full = tiles.matrix(b.column("_v"), width)

        def of(at: np.ndarray) -> np.ndarray:
            total = np.zeros((len(keys), 5))
            for lo in range(0, len(at), ROWS_TOGETHER):
                v = full[at[lo:lo + ROWS_TOGETHER]]
                here = ~np.isnan(v)
                scale = np.maximum(np.abs(v), 1e-9)
                k = 0
                for i, j, ts in pairs:
                    x, y = v[:, i], v[:, j]
                    target, size, to = v[:, ts], scale[:, ts], slice(k, k + len(ts))
                    total[to, 0] += (here[:, i] & here[:, j]) @ here[:, ts].astype(np.float64)
                    for f, form in enumerate((x * y, x + y, x - y, y - x), 1):
                        total[to, f] += (np.abs(target - form[:, None]) / size < RELATIVE_TOLERANCE).sum(0)
                    k += len(ts)
            return total

        def quiet(at: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):      # infinite forms match nothing
                return of(at)
        return quiet

    rows = clean.select(*by, F.array(*[f"_c{i}" for i in range(width)]).alias("_v"))
    out = tiles.summed(rows, by, ("valid", *FORMS), 3, work, keys)
    return out.select(*by, F.col("k0").alias("t"), F.col("k1").alias("a"), F.col("k2").alias("b"),
                      *[F.col(c).cast("long").alias(c) for c in ("valid", *FORMS)])


def derived_pairs(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None,
                  among: DataFrame | None = None) -> DataFrame:
    """Unordered pairs {target, a} and {target, b} (``column_a < column_b``), by segment. ``among`` (``by..., column``)
    lists the columns that each segment looks at."""
    by = as_list(by)
    rel = derived_relationships(df, cols, by).select(*by, "target", "col_a", "col_b").distinct()
    for side in ("target", "col_a", "col_b") if among is not None else ():
        rel = keyed_join(rel, among.select(*by, F.col("column").alias(side)), by + [side], "left_semi")
    p = rel.select(*by, "target", F.col("col_a").alias("o")).unionByName(rel.select(*by, "target", F.col("col_b").alias("o")))
    return p.select(*by, F.least("target", "o").alias("column_a"), F.greatest("target", "o").alias("column_b")).distinct()
