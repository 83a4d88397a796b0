"""A7-A9, T1, T3 - pairwise Pearson association with multiple-testing control.

Up to :data:`DIRECT_COLUMNS` columns each row is expanded to its column pairs inside the
scan stage and aggregated there by (segment, pair) with Spark's stable co-moment
aggregates. Wider tables use masked co-moment tiles (``functions.tiles``): matrix products
over the rows, so that a row isn't multiplied by the number of pairs. Both give every pair;
only one small buffer per (partition, segment, pair) is shuffled. p-values, BH and ranking
run on the aggregated pair rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles
from ..functions.columns import as_list, num, numeric_columns
from ..functions.fdr import bh_adjust
from ..functions.joins import keyed_join
from ..functions.special import pearson_pvalue
from ..session import materialize

FDR_SIGNIFICANCE_LEVEL = 0.05
#: Columns up to which rows are expanded to pairs (at most 45 of them).
DIRECT_COLUMNS = 10
#: A centred sum of squares below this share of the raw one has lost digits that r needs.
LOST_DIGITS = 1e-3


def pair_stats(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """``by..., column_a, column_b, idx_a, idx_b, n, r`` for every pair of ``cols``.

    ``n`` counts rows where both columns are present; ``r`` is NULL when fewer
    than 3 such rows exist or one side is constant on them (pair not tested).
    A constant is told by its least and greatest value: its co-moments are only close to 0.
    """
    by = as_list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    names = F.array(*[F.lit(c) for c in cols])
    st = _tile_stats(df, cols, by) if len(cols) > DIRECT_COLUMNS else _direct_stats(df, cols, by, list(combinations(range(len(cols)), 2)))
    return st.select(*by, names[F.col("idx_a")].alias("column_a"), names[F.col("idx_b")].alias("column_b"), "idx_a", "idx_b", "n", "r")


def _direct_stats(df: DataFrame, cols: list[str], by: list[str], pairs: list[tuple[int, int]]) -> DataFrame:
    """``by..., idx_a, idx_b, n, r`` of the listed pairs: a row is expanded to its pairs in the scan stage."""
    if not pairs:
        kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
        return df.sparkSession.createDataFrame([], kinds + "idx_a int, idx_b int, n long, r double")
    index = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs]))
    rows = df.select(*by, F.array(*[num(c) for c in cols]).alias("_v")).select(*by, "_v", index.alias("_p"))
    rows = rows.select(*by, F.col("_p.i").alias("idx_a"), F.col("_p.j").alias("idx_b"),
                       F.col("_v")[F.col("_p.i")].alias("_x"), F.col("_v")[F.col("_p.j")].alias("_y"))
    st = rows.groupBy(*by, "idx_a", "idx_b").agg(
        F.regr_count("_y", "_x").alias("n"), F.regr_sxx("_y", "_x").alias("sxx"),
        F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"),
        *[f(F.when(F.col(o).isNotNull(), F.col(c))).alias(f"{k}{c}")
          for c, o in (("_x", "_y"), ("_y", "_x")) for k, f in (("lo", F.min), ("hi", F.max))])
    varied = (F.col("lo_x") < F.col("hi_x")) & (F.col("lo_y") < F.col("hi_y"))
    return st.select(*by, "idx_a", "idx_b", "n", F.when((F.col("n") >= 3) & varied, _bounded_r("sxy", "sxx", "syy")).alias("r"))


def _bounded_r(sxy: str, sxx: str, syy: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.try_divide(F.col(sxy), F.sqrt(sxx) * F.sqrt(syy))))


def _tile_stats(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """As :func:`_direct_stats` for all pairs, by matrix products over the rows (``functions.tiles``).

    Where the rows that a pair has in common lie far from a column's mean, or its values there are (nearly) constant, the
    sums lose digits: these few pairs are computed again one by one.
    """
    centre = materialize(tiles.wide_centres(df, cols, by))
    if by:
        sums = tiles.pair_sums(tiles.standardised(df, cols, by, centre), len(cols), by)
    else:                                             # one row, of as many numbers as columns
        one = centre.first()
        sums = tiles.pair_sums(tiles.raw_rows(df, cols, by), len(cols), by, centre=(one["_mu"], one["_sd"]))
    sums = keyed_join(sums, centre.select(*by, "_sd"), by)
    n = F.col("n").cast("double")
    sums = materialize(sums.select(
        *by, F.col("k0").alias("idx_a"), F.col("k1").alias("idx_b"), "n", "a2", "b2",
        (F.col("a2") - F.col("a1") ** 2 / n).alias("sxx"), (F.col("b2") - F.col("b1") ** 2 / n).alias("syy"),
        (F.col("ab") - F.col("a1") * F.col("b1") / n).alias("sxy"),
        ((F.col("_sd")[F.col("k0")] > 0) & (F.col("_sd")[F.col("k1")] > 0)).alias("varied")))
    odd = F.col("varied") & (F.col("n") >= 3) & ((F.col("sxx") < LOST_DIGITS * F.col("a2")) | (F.col("syy") < LOST_DIGITS * F.col("b2"))
                                                 | (F.col("a2") == 0) | (F.col("b2") == 0))
    sums = sums.withColumn("odd", odd)
    r = F.when((F.col("n") >= 3) & F.col("varied"), _bounded_r("sxy", "sxx", "syy"))
    fine = sums.where(~F.col("odd")).select(*by, "idx_a", "idx_b", "n", r.alias("r"))
    again = [(x["idx_a"], x["idx_b"]) for x in sums.where("odd").select("idx_a", "idx_b").distinct().collect()]  # pairs of columns
    if again:
        keys = [*by, "idx_a", "idx_b"]
        fine = fine.unionByName(keyed_join(_direct_stats(df, cols, by, again), sums.where("odd").select(*keys), keys, "left_semi"))
    # pairs without a common row are pairs all the same
    every = centre.select(*by, F.explode(F.array(*[F.struct(F.lit(i).alias("idx_a"), F.lit(j).alias("idx_b"))
                                                   for i, j in combinations(range(len(cols)), 2)])).alias("_p")).select(*by, "_p.*")
    out = keyed_join(every, fine, [*by, "idx_a", "idx_b"], "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def correlation_pvalues(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] | None = None,
                        alpha: float = FDR_SIGNIFICANCE_LEVEL, among: DataFrame | None = None) -> DataFrame:
    """A8+A9: r, two-sided p, BH-adjusted p and significance for each tested pair. ``among`` (``by..., column``)
    lists the columns that each segment tests."""
    by = as_list(by)
    stats = pair_stats(df, cols, by).where(F.col("r").isNotNull())
    for side in ("column_a", "column_b") if among is not None else ():
        stats = keyed_join(stats, among.select(*by, F.col("column").alias(side)), by + [side], "left_semi")
    stats = stats.withColumn("p_value", pearson_pvalue(F.col("r"), F.col("n")))
    out = bh_adjust(stats, "p_value", "p_value_adjusted", partition_by=by, tie_break=["idx_a", "idx_b"])
    return out.withColumn("significant", F.col("p_value_adjusted") < alpha)


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                       by: Sequence[str] | None = None) -> DataFrame:
    """Square Pearson matrix in long form ``by..., column_a, column_b, r`` (both orders + diagonal)."""
    by = as_list(by)
    cols = list(cols) if cols is not None else numeric_columns(df, exclude=by)
    st = pair_stats(df, cols, by).select(*by, "column_a", "column_b", "r")
    mirror = st.select(*by, F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "r")
    names = F.explode(F.array(*[F.lit(c) for c in cols]))
    seg = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    diag = seg.select(*by, names.alias("column_a")).withColumn("column_b", F.col("column_a")).withColumn("r", F.lit(1.0))
    return st.unionByName(mirror).unionByName(diag)


def top_pairs(pvals: DataFrame, k: int = 5, by: Sequence[str] | None = None,
              exclude: DataFrame | None = None) -> DataFrame:
    """The k strongest pairs by |r| (ties in column order), after
    dropping pairs listed in ``exclude`` (``column_a, column_b``, any order)."""
    by = as_list(by)
    if exclude is not None:
        ex = exclude.select(*[b for b in by if b in exclude.columns], F.least("column_a", "column_b").alias("_lo"),
                            F.greatest("column_a", "column_b").alias("_hi")).distinct()
        pvals = keyed_join(pvals.withColumn("_lo", F.least("column_a", "column_b")).withColumn("_hi", F.greatest("column_a", "column_b")),
                           ex, [*(b for b in by if b in ex.columns), "_lo", "_hi"], "left_anti").drop("_lo", "_hi")
    w = Window.partitionBy(*by).orderBy(F.abs("r").desc(), "idx_a", "idx_b")
    return pvals.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
