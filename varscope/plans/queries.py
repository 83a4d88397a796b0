"""Registered queries over the driver tables, each with its DuckDB oracle.

Every query reads whole tables (no row caps) and returns a DataFrame whose
floating columns are rounded to 8 significant digits with the same arithmetic
as the oracle (``oracle_sql.sig``) so that value hashes compare engines, not
summation order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import oracle_sql as O

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def sig(c: str | Column, digits: int = 8) -> Column:
    """Round to ``digits`` significant digits with engine-independent arithmetic:
    scale by an exact power of ten (<= 1e22), round to an integer, scale back.
    Magnitudes below 1e-15 become 0."""
    x = F.col(c) if isinstance(c, str) else c
    s = F.lit(digits - 1) - F.floor(F.log10(F.abs(x)))
    p_up = F.pow(F.lit(10.0), s)
    p_dn = F.pow(F.lit(10.0), -s)
    k = F.round(F.when(s >= 0, x * p_up).otherwise(x / p_dn), 0)
    scaled = F.when(s >= 0, k / p_up).otherwise(k * p_dn)
    return (F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x)
            .when(F.abs(x) < 1e-15, F.lit(0.0)).otherwise(scaled))


def rounded(df: DataFrame, cols: Sequence[str], digits: int = 8) -> DataFrame:
    return df.withColumns({c: sig(c, digits).alias(c) for c in cols})


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


# Import the query modules so that their @register decorators run.
from . import q_anova, q_association, q_ingest, q_model, q_profile, q_report, q_shape  # noqa: E402,F401
