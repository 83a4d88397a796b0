"""A9 - Benjamini-Hochberg adjusted p-values with window functions.

Runs on aggregated rows only (one row per tested pair/pattern), partitioned
by segment in grouped mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bh_adjust(df: DataFrame, p_col: str = "p_value", out_col: str = "p_value_adjusted",
              partition_by: Sequence[str] = (), tie_break: Sequence[str] = ()) -> DataFrame:
    """q_(i) = min(1, min_{j>=i} p_(j) * m / j), rows with NULL p are left NULL."""
    parts = list(partition_by)
    tested = F.col(p_col).isNotNull()
    w_all = Window.partitionBy(*parts, tested)
    w_rank = Window.partitionBy(*parts, tested).orderBy(F.col(p_col).asc(), *[F.col(c) for c in tie_break])
    w_tail = (Window.partitionBy(*parts, tested).orderBy(F.col("_bh_rank").desc())
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (df.withColumn("_bh_m", F.count(F.lit(1)).over(w_all))
              .withColumn("_bh_rank", F.row_number().over(w_rank))
              .withColumn("_bh_raw", F.col(p_col) * F.col("_bh_m") / F.col("_bh_rank"))
              .withColumn(out_col, F.when(tested, F.least(F.lit(1.0), F.min("_bh_raw").over(w_tail))))
              .drop("_bh_m", "_bh_rank", "_bh_raw"))
