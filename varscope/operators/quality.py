"""A1, A2, W5 - dataset validation: shape, missing cells, duplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import as_list, is_numeric
from ..functions.joins import keyed_join


def _is_missing(df: DataFrame, c: str):
    col = F.col(c)
    if is_numeric(df, c):
        return col.isNull() | F.isnan(col.cast("double"))
    return col.isNull()


def null_counts(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """``by..., column, position, n_rows, n_null, null_ratio`` from one wide aggregate."""
    by = as_list(by)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"),
                               *[F.count(F.when(_is_missing(df, c), 1)).alias(f"_n{i}") for i, c in enumerate(cols)])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(i).alias("position"),
                                 F.col(f"_n{i}").alias("n_null")) for i, c in enumerate(cols)])
    return (wide.select(*by, "_rows", F.explode(entries).alias("_e"))
            .select(*by, "_e.column", "_e.position", F.col("_rows").alias("n_rows"), "_e.n_null")
            .withColumn("null_ratio", F.col("n_null") / F.col("n_rows")))


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """A2: rows minus distinct rows over ``cols`` (NULLs compare equal), by segment.

    ``groupBy(cols).count()`` combines map-side, so a hot duplicated row
    collapses to one partial count per partition before the shuffle.
    """
    by = as_list(by)
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in by]
    g = df.groupBy(*by, *cols).count()
    return g.groupBy(*by).agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates_count"),
                 F.count(F.lit(1)).alias("distinct_rows"))


def duplicate_rows(df: DataFrame, cols: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows that repeat an earlier row on ``cols`` ("keep first" by ``order_by``).

    The first occurrence per value combination is an aggregate (``min`` of the ordering struct),
    joined back; no window holds a hot group in one task and AQE splits a skewed join side. Rows
    that tie with the first one are repeats but for one of them: each tie is counted, and of its
    rows, which agree on ``cols`` and ``order_by``, the first of a row number stays.
    """
    cols, order_by = list(cols), list(order_by)
    at = F.struct(*order_by)
    first = df.groupBy(*cols).agg(F.min(at).alias("_first"))
    j = keyed_join(df, first, cols)
    later = j.where(at != F.col("_first")).drop("_first")
    heads = j.where(at == F.col("_first")).drop("_first")
    tied = (df.groupBy(*cols, *[c for c in order_by if c not in cols]).count().where("count > 1")
            .select(*cols, *[c for c in order_by if c not in cols]))
    ties = keyed_join(heads, tied, tied.columns, "left_semi")
    w = Window.partitionBy(*tied.columns).orderBy(F.xxhash64(*df.columns))
    return later.unionByName(ties.withColumn("_r", F.row_number().over(w)).where("_r > 1").drop("_r"))


def validate_dataset(df: DataFrame, identifier_cols: Sequence[str] | None = None, by: Sequence[str] | None = None,
                     types: DataFrame | None = None) -> DataFrame:
    """A1: one row a segment ``by..., n_rows, n_columns, n_null_cells, duplicates_count``.

    Duplicates ignore identifier columns (all columns if every column is one). By segment a column can be an
    identifier in some and not in others (``types``: :func:`schema.column_types` by the same segments); where it
    is one, its values are left out of the comparison.
    """
    by = as_list(by)
    if by:
        return _validate_segments(df, by, types)
    if identifier_cols is None:
        from .schema import identifier_columns
        identifier_cols = identifier_columns(df)
    comp = [c for c in df.columns if c not in set(identifier_cols)] or df.columns
    nulls = null_counts(df).agg(F.first("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null_cells"))
    dups = duplicate_count(df, comp).select("duplicates_count")
    one = F.lit(1).alias("_one")
    return (nulls.select("*", one).join(F.broadcast(dups.select("*", one)), "_one")
            .select(F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                    F.lit(len(df.columns)).alias("n_columns"),
                    F.coalesce("n_null_cells", F.lit(0)).cast("long").alias("n_null_cells"),
                    "duplicates_count"))


def _validate_segments(df: DataFrame, by: list[str], types: DataFrame | None) -> DataFrame:
    from .schema import column_types
    cols = [c for c in df.columns if c not in by]
    types = column_types(df, cols, by=by) if types is None else types
    flags = types.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "is_identifier"))).alias("_of"),
                                   F.bool_and("is_identifier").alias("_all"))
    rows = keyed_join(df, flags, by)
    seen = [F.when(F.col("_all") | ~F.element_at("_of", F.lit(c)), F.struct(F.col(f"`{c}`"))).alias(f"_c{i}") for i, c in enumerate(cols)]
    dups = duplicate_count(rows.select(*by, *seen), by=by).select(*by, "duplicates_count")
    nulls = null_counts(df, cols, by).groupBy(*by).agg(F.first("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null_cells"))
    return keyed_join(nulls, dups, by).select(*by, "n_rows", F.lit(len(cols)).alias("n_columns"), "n_null_cells", "duplicates_count")
