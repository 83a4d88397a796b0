"""Distinct counts that are exact up to a limit and never move the values.

A rule such as "2 to 25 levels" needs no count of a million values. Values are hashed (one to one: 64 bits to 64 bits)
and the hash's first bits name a cell; a cell keeps only its least and greatest value. That state merges, has a fixed
number of cells a key and collapses before the shuffle, so a key that holds a third of all rows costs a task no more
than any other. A cell whose least value is its greatest holds one value. A cell that holds more counts for two at
least, which settles every key above the limit; for the few keys still open, the rows of such cells are split again
by the next bits. With all 64 bits each cell holds one value, so the rounds end.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .columns import is_numeric, num
from .joins import keyed_join, lookup_join

#: Bits of the hash that a round adds, for limits up to 256; more for larger ones.
ROUND_BITS = 10


def _cell(bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64("_v"), 64 - bits)


def _split(rows: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """keys..., single (cells of one value), pending (the cells of more)."""
    cells = rows.groupBy(*keys, _cell(bits).alias("_cell")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    return cells.groupBy(*keys).agg(F.count(F.when(F.col("_lo") == F.col("_hi"), 1)).alias("single"),
                                    F.collect_list(F.when(F.col("_lo") != F.col("_hi"), F.col("_cell"))).alias("pending"))


def few_distinct(rows: DataFrame, keys: Sequence[str], limit: int = 25, value: str = "value",
                 round_bits: int | None = None) -> DataFrame:
    """``keys..., n_distinct``: the number of distinct values of a column, exact up to ``limit`` and
    ``limit + 1`` for more.

    Numbers are doubles (-0.0 is 0.0, NaN is one value), other values are told apart by a 64-bit hash of their text.
    Null values count for nothing (a key with null values alone has no row); keys may be null. An empty table gives no rows.
    """
    keys = list(keys)
    step = round_bits or max(ROUND_BITS, (4 * limit).bit_length())
    v = F.col(value).cast("double") + F.lit(0.0) if is_numeric(rows, value) else F.xxhash64(F.col(value).cast("string"))
    rows = rows.where(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    bits = min(64, step)
    known = materialize(_split(rows, keys, bits))
    at_least = F.col("single") + 2 * F.size("pending")
    while bits < 64:
        still = known.where((at_least <= limit) & (F.size("pending") > 0))
        if still.isEmpty():
            break
        cells = still.select(*keys, F.explode("pending").alias("_cell"))
        inside = lookup_join(rows.withColumn("_cell", _cell(bits)), cells, keys, extra=["_cell"]).drop("_cell")
        bits = min(64, bits + step)
        more = _split(inside, keys, bits).withColumnsRenamed({"single": "_single", "pending": "_pending"})
        known = materialize(keyed_join(known, more, keys, "left").select(
            *keys, (F.col("single") + F.coalesce("_single", F.lit(0))).alias("single"), F.coalesce("_pending", "pending").alias("pending")))
    return known.select(*keys, F.least(at_least, F.lit(limit + 1)).cast("long").alias("n_distinct"))


def few_distinct_columns(df: DataFrame, cols: Sequence[str], limit: int, by: Sequence[str] = ()) -> DataFrame:
    """``by..., column, n_distinct`` of many columns, as ``distinct_counts`` has it, but exact up to ``limit`` only
    (``limit + 1`` for more): an identifier's values don't move just to learn that there are many. NaN is missing."""
    cols, by = list(cols), list(by)
    nums = [c for c in cols if is_numeric(df, c)]
    parts = []
    for names, clean in ((nums, num), ([c for c in cols if c not in set(nums)], lambda c: F.col(c).cast("string"))):
        if names:
            wide = df.select(*by, *[clean(c).alias(c) for c in names])
            parts.append(few_distinct(wide.unpivot(by, names, "column", "value"), [*by, "column"], limit))
    return reduce(DataFrame.unionByName, parts)
