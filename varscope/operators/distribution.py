"""A15, A17-A21 - distribution shape detectors over the shared column profile.

All flags are CASE expressions over one long-form profile aggregate
(moments + exact median and p95), so every column of every segment is
classified by the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list
from .profile import column_profile

ASYMMETRY_THRESHOLD = 0.4
COUNT_DATA_LEVELS = 12


def count_data_flag(min_rows=10, max_unique=COUNT_DATA_LEVELS, max_value=30.0, max_mean=10.0):
    return ((F.col("n") >= min_rows) & F.col("integer_like") & (F.col("vmin") >= 0)
            & (F.col("n_distinct") <= max_unique) & (F.col("vmax") <= max_value)
            & (F.col("mean") > 0) & (F.col("mean") <= max_mean)
            & ((F.col("n_distinct") <= 8) | (F.col("zero_ratio") >= 0.2)))


def zero_inflation_flag(min_rows=10, zero_threshold=0.45):
    return ((F.col("n") >= min_rows) & (F.col("n_distinct") > 2) & (F.col("vmin") >= 0)
            & (F.col("zero_ratio") > zero_threshold) & ((F.col("n") - F.col("n_zero")) >= 2))


def heavy_tail_flag(min_rows=10, skew_threshold=1.5, kurtosis_threshold=1.0, tail_ratio_threshold=5.0):
    return ((F.col("n") >= min_rows) & (F.col("vmin") >= 0) & (F.col("n_zero") < F.col("n"))
            & (F.col("skewness") > skew_threshold) & (F.col("kurtosis") > kurtosis_threshold)
            & (F.col("median") > 0) & (F.col("tail_ratio") >= tail_ratio_threshold))


def distribution_profile(df: DataFrame, cols: Sequence[str] | None = None,
                         by: Sequence[str] | None = None, count_to: int | None = None) -> DataFrame:
    """``by..., column, n, mean, variance, skewness, kurtosis, median, p95,
    tail_ratio, zero_ratio, positive_fraction, nonzero_mean, n_distinct,
    is_count_data, is_zero_inflated, is_heavy_tail, asymmetry, is_asymmetric``.

    ``count_to`` (12 or more; see :func:`column_profile`): ``n_distinct`` up to that number, the flags are the same."""
    if count_to is not None and count_to < COUNT_DATA_LEVELS:
        raise ValueError(f"count_to must be at least {COUNT_DATA_LEVELS}")
    by = as_list(by)
    p = column_profile(df, cols, by, probs=(0.5, 0.95), count_to=count_to)
    p = (p.withColumn("median", F.col("quantiles")[0]).withColumn("p95", F.col("quantiles")[1])
          .withColumn("tail_ratio", F.when(F.col("median") > 0, F.col("p95") / F.col("median")).otherwise(F.lit(0.0)))
          .withColumn("positive_fraction", F.col("n_positive") / F.col("n"))
          .withColumn("asymmetry", F.when(F.col("std") > 0, F.abs(F.col("mean") - F.col("median")) / F.col("std"))))
    return p.select(
        *by, "column", "n", "mean", "std", "variance", "vmin", "vmax", "skewness", "kurtosis", "median", "p95",
        "tail_ratio", "zero_ratio", "positive_fraction", "nonzero_mean", "n_distinct", "integer_like",
        F.coalesce(count_data_flag(), F.lit(False)).alias("is_count_data"),
        F.coalesce(zero_inflation_flag(), F.lit(False)).alias("is_zero_inflated"),
        F.coalesce(heavy_tail_flag(), F.lit(False)).alias("is_heavy_tail"),
        "asymmetry",
        F.coalesce(F.col("asymmetry") > ASYMMETRY_THRESHOLD, F.lit(False)).alias("is_asymmetric"))
