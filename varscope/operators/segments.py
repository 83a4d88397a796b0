"""A25 - per-segment analysis, re-aimed.

The reference loops over groups and runs a whole report per group in
pandas. Here the operators take ``by=[...]`` (all but ``one_hot``, ``duplicate_rows``
and the helpers that look at names only) and compute all segments in
the same job; this module only provides the segment bookkeeping: sizes and
the rows of segments large enough to analyse (the reference skips groups
under ``min_group_size`` rows). The size table is an aggregate (one row per
segment); joining it back is an equi-join that AQE can split when one
segment is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import as_list
from ..functions.joins import keyed_join

MIN_GROUP_SIZE = 3


def segment_sizes(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., n_rows, segment`` where ``segment`` joins the key parts with '_'."""
    by = as_list(by)
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("segment", F.concat_ws("_", *[F.coalesce(F.col(b).cast("string"), F.lit("nan")) for b in by])))


def eligible_segments(df: DataFrame, by: Sequence[str], min_group_size: int = MIN_GROUP_SIZE) -> DataFrame:
    """Rows of the segments with at least ``min_group_size`` rows (NULL keys form a segment)."""
    by = as_list(by)
    ok = segment_sizes(df, by).where(F.col("n_rows") >= min_group_size).select(*by)
    return keyed_join(df, ok, by, "left_semi") if by else df
