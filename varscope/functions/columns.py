"""Column helpers: numeric cleaning, type tests, long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_list(cols: str | Sequence[str] | None) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def num(c: str | Column) -> Column:
    """A numeric column as double with NaN and +-inf turned into NULL.

    pandas treats NaN as missing; Spark keeps NaN apart from NULL and lets it
    win in ``max``/``avg``/``percentile``. Every operator cleans its numeric
    inputs once with this expression.
    """
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    dt = field_type(df, name)
    return isinstance(dt, NUMERIC_TYPES) and not isinstance(dt, T.BooleanType)


def is_integral(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), INTEGRAL_TYPES)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.StringType, T.VarcharType, T.CharType))


def is_temporal(df: DataFrame, name: str) -> bool:
    return isinstance(field_type(df, name), (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns in schema order (metadata only, no job)."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and is_numeric(df, f.name)]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if f.name not in skip and is_text(df, f.name)]


def long_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                 keep_nulls: bool = False) -> DataFrame:
    """Unpivot numeric columns to ``(by..., column, value)`` with cleaned doubles.

    The unpivot is an ``Expand`` inside the scan stage: it multiplies rows by
    ``len(cols)`` before the map-side partial aggregation, so only partial
    aggregates are shuffled by the grouped operators built on top of it.
    """
    cols = list(cols)
    by = list(by)
    wide = df.select(*by, *[num(c).alias(c) for c in cols])
    out = wide.unpivot(by, cols, "column", "value") if by else wide.unpivot([], cols, "column", "value")
    if not keep_nulls:
        out = out.where(F.col("value").isNotNull())
    return out


def distinct_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Exact non-null distinct counts ``by..., column, n_distinct`` for many columns.

    Long form + two-level ``groupBy`` (distinct (segment, column, value) triples, then a
    count per column): one shuffle of distinct pairs, instead of the
    row-multiplying ``Expand`` that several ``count(DISTINCT ...)`` in one
    aggregate produce. Numeric columns are compared as cleaned doubles
    (NaN is missing; -0.0 equals 0.0), other columns as strings.
    """
    cols, by = list(cols), list(by)
    nums = [c for c in cols if is_numeric(df, c)]
    others = [c for c in cols if c not in set(nums)]
    parts = []
    if nums:
        ln = (df.select(*by, *[(num(c) + F.lit(0.0)).alias(c) for c in nums])
              .unpivot(by, nums, "column", "value").where(F.col("value").isNotNull()))
        parts.append(ln.select(*by, "column", "value").distinct()
                     .groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n_distinct")))
    if others:
        lo = (df.select(*by, *[F.col(c).cast("string").alias(c) for c in others])
              .unpivot(by, others, "column", "value").where(F.col("value").isNotNull()))
        parts.append(lo.select(*by, "column", "value").distinct()
                     .groupBy(*by, "column").agg(F.count(F.lit(1)).alias("n_distinct")))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out
