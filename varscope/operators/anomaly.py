"""A6 / P8 - IQR outliers (Tukey fences), per column and per segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list, long_numeric, num, numeric_columns
from ..functions.joins import keyed_join, lookup_join
from ..functions.quantiles import exact_quantiles

MIN_RELIABLE_SAMPLE_SIZE = 30


def iqr_bounds(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5,
               by: Sequence[str] | None = None) -> DataFrame:
    """``by..., column, n, n_valid, q1, q3, lower_bound, upper_bound, n_outliers, reliable``.

    ``n`` counts rows including NULLs, as the reference does; quartiles use
    linear interpolation on the non-null values; fences are strict.
    """
    if k <= 0:
        raise ValueError(f"k must be strictly positive (got {k})")
    by = as_list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    for c in cols:
        if c not in numeric_columns(df):
            raise TypeError(f"IQR needs a numeric column: {c}")
    keys = by + ["column"]
    full = long_numeric(df, cols, by, keep_nulls=True)
    counts = full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"),
                                     F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    counts = counts.cache()
    valid = full.where(F.col("value").isNotNull())
    q = exact_quantiles(valid, keys, "value", (0.25, 0.75),
                        stats=counts.select(*keys, F.col("n_valid").alias("n"), "vmin", "vmax"))
    b = (keyed_join(counts.drop("vmin", "vmax"), q.drop("n"), keys, "left")
         .withColumn("q1", F.col("quantiles")[0]).withColumn("q3", F.col("quantiles")[1])
         .withColumn("lower_bound", F.col("q1") - k * (F.col("q3") - F.col("q1")))
         .withColumn("upper_bound", F.col("q3") + k * (F.col("q3") - F.col("q1")))
         .drop("quantiles"))
    b = b.cache()
    flagged = (lookup_join(valid, b.select(*keys, "lower_bound", "upper_bound"), keys)
               .where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_outliers")))
    out = keyed_join(b, flagged, keys, "left")
    return (out.withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0)).cast("long"))
               .withColumn("reliable", F.col("n") >= MIN_RELIABLE_SAMPLE_SIZE))


def iqr_outliers(df: DataFrame, col: str, k: float = 1.5, by: Sequence[str] | None = None,
                 key_cols: Sequence[str] | None = None) -> DataFrame:
    """The outlying rows themselves (keyed, since Spark rows have no position)."""
    by = as_list(by)
    keys_out = as_list(key_cols)
    bounds = iqr_bounds(df, [col], k, by).select(*by, "lower_bound", "upper_bound")
    rows = df.select(*keys_out, *[c for c in by if c not in keys_out], num(col).alias("value"))
    if by:
        j = lookup_join(rows, bounds, by)
    else:  # one bounds row: a broadcast equi-join on a constant key
        j = rows.withColumn("_one", F.lit(1)).join(F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one")
    return j.where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))
