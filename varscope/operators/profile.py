"""A3, A4, A17 - per-column profile in one long-form aggregate.

All numeric columns are unpivoted to ``(by..., column, value)`` inside the scan
stage and aggregated together, so one job profiles every column of every
segment. Exact quantiles come from the distributed selector in
``functions.quantiles`` (no group is ever held whole in one task). Distinct values
are counted apart from the moments, so that no value carries their buffers through
the shuffle, and where only few are asked for (``count_to``) values don't move at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, distinct_counts, long_numeric, numeric_columns
from ..functions.distinct import few_distinct
from ..functions.joins import keyed_join
from ..functions.quantiles import exact_quantiles

DEFAULT_PROBS = (0.25, 0.5, 0.75, 0.95)


def moments(long_df: DataFrame, keys: Sequence[str], extra: Sequence | None = None) -> DataFrame:
    """Per key: n, mean, std (sample), var, min, max, zeros, positives,
    integer-likeness, population skewness and excess kurtosis."""
    v = F.col("value")
    return long_df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.var_samp(v).alias("variance"),
        F.min(v).alias("vmin"),
        F.max(v).alias("vmax"),
        F.count(F.when(v == 0, 1)).alias("n_zero"),
        F.count(F.when(v > 0, 1)).alias("n_positive"),
        F.bool_and(F.abs(v - F.round(v)) <= 1e-8).alias("integer_like"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
        F.avg(F.when(v != 0, v)).alias("nonzero_mean"),
        *(extra or []),
    )


def column_profile(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None,
                   probs: Sequence[float] = DEFAULT_PROBS, approx_distinct: bool = False,
                   with_distinct: bool = True, accuracy: str = "exact",
                   approx_accuracy: int = 10_000, count_to: int | None = None) -> DataFrame:
    """``by..., column, n, mean, std, variance, vmin, vmax, n_distinct, n_zero,
    n_positive, integer_like, skewness, kurtosis, nonzero_mean, zero_ratio, quantiles``.

    ``accuracy="exact"`` (default) gives linear-interpolation quantiles by
    distributed selection; ``accuracy="approx"`` computes ``percentile_approx``
    (rank error <= n / ``approx_accuracy``) inside the same single aggregate.
    ``n_distinct`` is exact; with ``count_to`` it is exact up to that number and one more for
    all above it, which needs no shuffle of values (``functions.distinct``); with
    ``approx_distinct`` it is a sketch's; null without ``with_distinct``.
    """
    if accuracy not in ("exact", "approx"):
        raise ValueError("accuracy must be 'exact' or 'approx'")
    by = as_list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    keys = by + ["column"]
    long_df = long_numeric(df, cols, by)
    extra = [F.approx_count_distinct("value").alias("n_distinct")] if approx_distinct and with_distinct else []
    if accuracy == "approx":
        extra.append(F.percentile_approx("value", [float(p) for p in probs], approx_accuracy).alias("quantiles"))
        out = moments(long_df, keys, extra)
    else:
        mom = moments(long_df, keys, extra).cache()  # one scan of lineage; reused by the quantile step and the output
        q = exact_quantiles(long_df, keys, "value", probs, stats=mom.select(*keys, "n", "vmin", "vmax"))
        out = keyed_join(mom, q.drop("n"), keys, "left")
    if not with_distinct:
        out = out.withColumn("n_distinct", F.lit(None).cast("long"))
    elif not approx_distinct:
        counts = distinct_counts(df, cols, by) if count_to is None else few_distinct(long_df, keys, count_to)
        out = keyed_join(out, counts, keys, "left")
    return out.withColumn("zero_ratio", F.col("n_zero") / F.col("n"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None,
             accuracy: str = "exact") -> DataFrame:
    """A3: n, mean, sample std, min, max, median per column (and segment)."""
    by = as_list(by)
    prof = column_profile(df, cols, by, probs=(0.5,), with_distinct=False, accuracy=accuracy)
    return prof.select(*by, "column", "n", "mean", "std", F.col("vmin").alias("min"),
                       F.col("vmax").alias("max"), F.col("quantiles")[0].alias("median"))
