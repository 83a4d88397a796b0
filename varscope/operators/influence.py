"""R6, R7 - Cook's distance of a simple linear fit and influential rows.

One aggregate gives the fit per segment (``regr_*``); it is joined back to
the rows (broadcast for the one-row global case) and D is a column
expression: no second model fit, no per-row Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, num
from ..functions.joins import keyed_join, lookup_join
from .regression import _check_numeric, ols_from_stats, simple_fit_stats, two_valued

DEFAULT_THRESHOLD_RATIO = 4.0


def _attach(rows: DataFrame, fit: DataFrame, by: list[str]) -> DataFrame:
    return lookup_join(rows, fit, by)


def cooks_distance(df: DataFrame, feature: str, target: str, by: Sequence[str] | None = None,
                   key_cols: Sequence[str] | None = None, fit_stats: DataFrame | None = None) -> DataFrame:
    """``key_cols..., by..., x, y, residual, leverage, cooks_d, n`` for every complete row.

    p = 2; mse = SSE/(n-2); mse close to 0 (|mse| <= 1e-8) gives zeros; a
    two-valued target (logistic branch in the reference) gives zeros.
    """
    _check_numeric(df, [feature, target])
    by, keys = as_list(by), as_list(key_cols)
    st = ols_from_stats(fit_stats if fit_stats is not None else simple_fit_stats(df, target, feature, by))
    st = st.withColumn("mse", F.try_divide(F.col("sse"), F.col("n") - 2))
    st = keyed_join(st, two_valued(df, target, by), by, "left")
    rows = df.select(*keys, *[b for b in by if b not in keys], num(feature).alias("x"), num(target).alias("y"))
    rows = rows.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    j = _attach(rows, st.select(*by, "n", "slope", "intercept", "mean_x", "sxx", "mse", "two_valued"), by)
    e = F.col("y") - (F.col("intercept") + F.col("slope") * F.col("x"))
    h = 1 / F.col("n") + F.try_divide((F.col("x") - F.col("mean_x")) ** 2, F.col("sxx"))
    d = F.try_divide(e * e, 2 * F.col("mse")) * F.try_divide(h, (1 - h) ** 2)
    zero = F.coalesce("two_valued", F.lit(False)) | F.col("slope").isNull() | (F.abs(F.col("mse")) <= 1e-8)
    return j.select(*keys, *[b for b in by if b not in keys], "x", "y", e.alias("residual"), h.alias("leverage"),
                    F.when(zero, F.lit(0.0)).otherwise(d).alias("cooks_d"), "n")


def influential_points(df: DataFrame, feature: str, target: str, key_cols: Sequence[str],
                       by: Sequence[str] | None = None,
                       threshold_ratio: float = DEFAULT_THRESHOLD_RATIO,
                       fit_stats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with D > ratio/n, summary per segment: n, threshold, max_distance,
    max_distance_key, n_influential)."""
    by, keys = as_list(by), as_list(key_cols)
    cd = cooks_distance(df, feature, target, by, keys, fit_stats).withColumn("threshold", threshold_ratio / F.col("n"))
    rows = cd.where(F.col("cooks_d") > F.col("threshold"))
    key = F.struct(*keys) if len(keys) > 1 else F.col(keys[0])
    summary = cd.groupBy(*by).agg(
        F.first("n").alias("n"), F.first("threshold").alias("threshold"),
        F.max("cooks_d").alias("max_distance"),
        F.max_by(key, F.struct("cooks_d", *[F.col(k) for k in keys])).alias("max_distance_key"),
        F.count(F.when(F.col("cooks_d") > F.col("threshold"), 1)).alias("n_influential"))
    return rows, summary
