"""A22, A23 - "level" (step-valued business) features.

A feature is level-like when it has few distinct values (2..25), is not
count data, has on average >= 2 rows per value and a mean gap between its
sorted distinct values >= 0.1 std. The mean gap of sorted distinct values is
(max - min) / (distinct - 1), so no sort is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, is_numeric, long_numeric, num
from ..functions.distinct import few_distinct
from ..functions.joins import keyed_join
from .anova import level_stats
from .distribution import COUNT_DATA_LEVELS, count_data_flag
from .profile import moments

MAX_LEVELS = 25
WITHIN_RATIO = 0.60


def level_flag(max_unique: int = MAX_LEVELS):
    gap = F.try_divide(F.col("vmax") - F.col("vmin"), F.col("n_distinct") - 1)
    return ((F.col("n") >= 10) & ~F.coalesce(count_data_flag(), F.lit(False))
            & (F.col("n_distinct") >= 2) & (F.col("n_distinct") <= max_unique)
            & (F.col("std") > 0) & (F.col("n") / F.col("n_distinct") >= 2) & (gap >= 0.1 * F.col("std")))


def _counted(df: DataFrame, cols: Sequence[str], by: list[str], limit: int) -> DataFrame:
    """What the flag needs of each column: one aggregate, and the distinct values up to the limit."""
    keys, rows = by + ["column"], long_numeric(df, cols, by)
    out = keyed_join(moments(rows, keys), few_distinct(rows, keys, limit), keys, "left")
    return out.withColumns({"n_distinct": F.when(F.col("n_distinct") <= limit, F.col("n_distinct")),
                            "zero_ratio": F.col("n_zero") / F.col("n")})


def level_features(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None,
                   max_unique: int = MAX_LEVELS, profile: DataFrame | None = None, count_to: int = MAX_LEVELS) -> DataFrame:
    """``by..., column, n, n_distinct, std, mean_gap, is_level_feature``.

    Values are counted up to ``count_to`` or ``max_unique``, the greater one; a column with more has a null
    ``n_distinct`` and ``mean_gap``.
    ``profile`` (a ``column_profile`` result covering ``cols``) avoids a second profile job."""
    by = as_list(by)
    cols = [c for c in (cols or df.columns) if c not in by and is_numeric(df, c)]
    if not cols:
        extra = "".join(f"`{b}` {df.schema[b].dataType.simpleString()}, " for b in by)
        return df.sparkSession.createDataFrame(
            [], extra + "column string, n long, n_distinct long, std double, mean_gap double, is_level_feature boolean")
    p = (profile.where(F.col("column").isin(*cols)) if profile is not None
         else _counted(df, cols, by, max(count_to, max_unique, COUNT_DATA_LEVELS)))
    return p.select(*by, "column", "n", "n_distinct", "std",
                    F.try_divide(F.col("vmax") - F.col("vmin"), F.col("n_distinct") - 1).alias("mean_gap"),
                    F.coalesce(level_flag(max_unique), F.lit(False)).alias("is_level_feature"))


def level_feature_for_simulation(df: DataFrame, feature: str, target: str | None = None,
                                 by: Sequence[str] | None = None, max_unique: int = MAX_LEVELS,
                                 profile: DataFrame | None = None) -> DataFrame:
    """A22 on the feature, and (with a target) the mean within-level sample
    std of the target must be <= 0.60 x its global std (levels with one row ignored)."""
    by = as_list(by)
    lf = level_features(df, [feature], by, max_unique, profile).drop("column")
    if target is None or not is_numeric(df, target):
        return lf.withColumn("within_ratio", F.lit(None).cast("double"))
    lv = level_stats(df, [target], [feature], by).where(F.col("n") >= 2)
    within = lv.groupBy(*by).agg(
        F.avg(F.sqrt(F.col("var_pop") * F.col("n") / (F.col("n") - 1))).alias("mean_within_std"))
    glob = df.groupBy(*by).agg(F.stddev_samp(num(target)).alias("global_std"))
    out = keyed_join(keyed_join(lf, within, by, "left"), glob, by, "left")
    ratio = F.try_divide(F.col("mean_within_std"), F.col("global_std"))
    checked = F.col("mean_within_std").isNotNull() & (F.col("global_std") > 0)
    return (out.withColumn("within_ratio", F.when(checked, ratio))
               .withColumn("is_level_feature",
                           F.col("is_level_feature") & ~(checked & (ratio > WITHIN_RATIO))))
