"""R4, R5, R10 - non-linear shape between a feature and a target.

Quadratic (R4): power sums of the standardised feature (orders 0..4) and of
the centred target against them, for every pair at once by matrix products
over the rows (``functions.tiles``); the 3x3 least-squares solve is column algebra (Cramer) on the
aggregated row. The t statistic of the squared term is invariant to the
affine standardisation; the coefficient is rescaled by 1/s^2.

Step (R5): exact quantile edges per pair (distributed selection), a bin per
row from the edges (right-closed, lowest included), then the one-way ANOVA
of ``anova.eta_from_levels``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tiles
from ..functions.columns import as_list, long_numeric, num
from ..functions.fdr import bh_adjust
from ..functions.joins import keyed_join
from ..functions.quantiles import exact_quantiles
from ..functions.special import t_pvalue
from ..session import materialize
from .anova import eta_from_levels

MIN_ROWS_FOR_NONLINEARITY = 10
QUADRATIC_IMPROVEMENT_THRESHOLD = 0.04
QUADRATIC_P_VALUE_THRESHOLD = 0.10
ETA_SQUARED_IMPROVEMENT_THRESHOLD = 0.02
STEP_P_VALUE_THRESHOLD = 0.05
#: Pairs up to which every sum is an aggregate of its own (whole-stage code generation ends at 100 fields).
DIRECT_AGGREGATES = 8
#: Pairs up to which rows are expanded to pairs.
DIRECT_PAIRS = 24
#: A centred sum of squares below this share of the raw one has lost digits.
LOST_DIGITS = 1e-3


def _pairs(pairs) -> list[tuple[str, str]]:
    return [(t, f) for t, f in pairs]


def empty_patterns(df: DataFrame, by: list[str]) -> DataFrame:
    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)
    return df.sparkSession.createDataFrame(
        [], kinds + "target string, feature string, n long, r2_linear_adj double, r2_quadratic_adj double, "
                    "quadratic_coefficient double, t_statistic double, p_value double, improvement double, "
                    "detected boolean, pattern_type string")


def _pair_index(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """``target, feature, j, i`` of the pairs: at most one row per ordered pair of columns."""
    idx = {c: i for i, c in enumerate(cols)}
    return df.sparkSession.createDataFrame([(t, f, idx[t], idx[f]) for t, f in dict.fromkeys(pairs)],
                                           "target string, feature string, j int, i int")


def _both_ways(sums: DataFrame, by: list[str], fourth: bool) -> DataFrame:
    """Sums of pairs i < j as rows of (feature i, target j) in both directions."""
    ways = []
    for i, j, a, b, aab in (("k0", "k1", "a", "b", "aab"), ("k1", "k0", "b", "a", "abb")):
        powers = [(f"{a}{p}", f"s{p}") for p in ((1, 2, 3, 4) if fourth else (1, 2))]
        cols = [(i, "i"), (j, "j"), ("n", "n"), *powers, (f"{b}1", "sy"), (f"{b}2", "syy"), ("ab", "szy"),
                *([(aab, "szzy")] if fourth else [])]
        ways.append(sums.select(*by, *[F.col(x).alias(y) for x, y in cols]))
    return ways[0].unionByName(ways[1])


def _direct_quadratic_sums(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]], by: list[str]) -> DataFrame:
    """As :func:`_quadratic_sums` for a few pairs: eleven aggregates a pair in one scan."""
    idx = {c: i for i, c in enumerate(cols)}
    cen = df.groupBy(*by).agg(*[f(num(c)).alias(f"{k}{i}") for i, c in enumerate(cols) for k, f in (("mu", F.avg), ("sd", F.stddev_samp))])
    rows = keyed_join(df.select(*by, *[num(c).alias(f"v{idx[c]}") for c in cols]), cen, by)
    aggs = []
    for k, (tg, ft) in enumerate(pairs):
        i, j = idx[ft], idx[tg]
        ok = F.col(f"v{i}").isNotNull() & F.col(f"v{j}").isNotNull() & (F.col(f"sd{i}") > 0)
        z = F.when(ok, (F.col(f"v{i}") - F.col(f"mu{i}")) / F.col(f"sd{i}"))
        y = F.when(ok, F.col(f"v{j}") - F.col(f"mu{j}"))
        aggs += [F.count(z).alias(f"p{k}_n"), *[F.sum(z ** p).alias(f"p{k}_s{p}") for p in (1, 2, 3, 4)],
                 F.sum(y).alias(f"p{k}_sy"), F.sum(y * y).alias(f"p{k}_syy"), F.sum(z * y).alias(f"p{k}_szy"),
                 F.sum(z * z * y).alias(f"p{k}_szzy"), F.first(F.col(f"sd{i}")).alias(f"p{k}_sd")]
    names = ("n", "s1", "s2", "s3", "s4", "sy", "syy", "szy", "szzy", "sd")
    entries = F.array(*[F.struct(F.lit(tg).alias("target"), F.lit(ft).alias("feature"), *[F.col(f"p{k}_{c}").alias(c) for c in names])
                        for k, (tg, ft) in enumerate(pairs)])
    return rows.groupBy(*by).agg(*aggs).select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*")


def _quadratic_sums(df: DataFrame, cols: list[str], pairs: list[tuple[str, str]], by: list[str], centre: DataFrame) -> DataFrame:
    """``by..., target, feature, n, s1..s4, sy, syy, szy, szzy, sd``: power sums of the standardised feature and of the
    target's differences from its mean, for every pair in one scan by matrix products."""
    sums = tiles.pair_sums(tiles.standardised(df, cols, by, centre), len(cols), by, fourth=True)
    st = _both_ways(materialize(sums), by, True)
    st = st.join(F.broadcast(_pair_index(df, cols, pairs)), ["i", "j"])
    st = keyed_join(st, centre.select(*by, "_sd"), by).where(F.col("_sd")[F.col("i")] > 0)
    sd_y = F.col("_sd")[F.col("j")]
    return st.select(*by, "target", "feature", "n", "s1", "s2", "s3", "s4", *[(F.col(c) * sd_y).alias(c) for c in ("sy", "szy", "szzy")],
                     (F.col("syy") * sd_y * sd_y).alias("syy"), F.col("_sd")[F.col("i")].alias("sd"))


def quadratic_patterns(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] | None = None,
                       keep_all: bool = False) -> DataFrame:
    """R4 for (target, feature) pairs: ``by..., target, feature, n, r2_linear_adj,
    r2_quadratic_adj, improvement, quadratic_coefficient, t_statistic, p_value,
    pattern_type, detected``."""
    by = as_list(by)
    pairs = _pairs(pairs)
    cols = sorted({c for p in pairs for c in p})
    if not pairs:
        return empty_patterns(df, by)
    if len(pairs) > DIRECT_AGGREGATES:
        st = _quadratic_sums(df, cols, pairs, by, materialize(tiles.centres(df, cols, by)))
    else:
        st = _direct_quadratic_sums(df, cols, pairs, by)
    n = F.col("n").cast("double")
    s1, s2, s3, s4 = (F.col(f"s{p}") for p in (1, 2, 3, 4))
    sy, syy, szy, szzy = F.col("sy"), F.col("syy"), F.col("szy"), F.col("szzy")
    dv = F.try_divide
    sst = syy - dv(sy * sy, n)
    # linear
    cxx = s2 - dv(s1 * s1, n)
    cxy = szy - dv(s1 * sy, n)
    sse_lin = sst - dv(cxy * cxy, cxx)
    r2_lin = F.when(sst > 0, 1 - dv(sse_lin, sst)).otherwise(F.lit(0.0))
    # quadratic: normal matrix A = [[n,s1,s2],[s1,s2,s3],[s2,s3,s4]], rhs [sy, szy, szzy]
    det = n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
    da = sy * (s2 * s4 - s3 * s3) - s1 * (szy * s4 - s3 * szzy) + s2 * (szy * s3 - s2 * szzy)
    db = n * (szy * s4 - szzy * s3) - sy * (s1 * s4 - s3 * s2) + s2 * (s1 * szzy - szy * s2)
    dc = n * (s2 * szzy - s3 * szy) - s1 * (s1 * szzy - s2 * szy) + sy * (s1 * s3 - s2 * s2)
    a, b, c = dv(da, det), dv(db, det), dv(dc, det)
    sse_q = F.greatest(F.lit(0.0), syy - (a * sy + b * szy + c * szzy))
    r2_q = F.when(sst > 0, 1 - dv(sse_q, sst)).otherwise(F.lit(0.0))
    r2l_adj = 1 - dv((1 - r2_lin) * (n - 1), n - 2)
    r2q_adj = 1 - dv((1 - r2_q) * (n - 1), n - 3)
    mse = dv(sse_q, n - 3)
    var_c = dv(mse * (n * s2 - s1 * s1), det)
    se = F.sqrt(F.greatest(var_c, F.lit(0.0)))
    tstat = F.when(se > 0, dv(c, se))
    pval = F.when(se > 0, t_pvalue(dv(c, se), n - 3)).when(c != 0, F.lit(0.0)).otherwise(F.lit(1.0))
    res = st.select(*by, "target", "feature", "n",
                    r2l_adj.alias("r2_linear_adj"), r2q_adj.alias("r2_quadratic_adj"),
                    dv(c, F.col("sd") * F.col("sd")).alias("quadratic_coefficient"),
                    tstat.alias("t_statistic"), pval.alias("p_value"),
                    ((F.col("n") >= MIN_ROWS_FOR_NONLINEARITY) & (cxx > 0) & (det != 0)).alias("_valid"))
    res = res.withColumn("improvement", F.col("r2_quadratic_adj") - F.col("r2_linear_adj"))
    detected = (F.col("_valid") & (F.col("r2_quadratic_adj") > F.col("r2_linear_adj"))
                & (F.col("improvement") >= QUADRATIC_IMPROVEMENT_THRESHOLD)
                & (F.col("p_value") <= QUADRATIC_P_VALUE_THRESHOLD))
    res = (res.withColumn("detected", F.coalesce(detected, F.lit(False)))
              .withColumn("pattern_type", F.when(F.col("quadratic_coefficient") > 0, F.lit("u_curve"))
                          .otherwise(F.lit("optimum")))
              .where("_valid").drop("_valid"))
    return res if keep_all else res.where("detected")


def _step_by_pair(df: DataFrame, pairs: Sequence[tuple[str, str]], by: list[str],
                  max_bins: int = 5, min_group_size: int = 5) -> DataFrame:
    """Steps of a few pairs, or of pairs whose target misses where the feature is present: a row is expanded to its
    pairs and each pair has edges of its own."""
    entries = F.array(*[F.struct(F.lit(k).alias("pid"), F.lit(tg).alias("target"), F.lit(ft).alias("feature"),
                                 num(ft).alias("x"), num(tg).alias("y")) for k, (tg, ft) in enumerate(pairs)])
    long_df = (df.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*")
               .where(F.col("x").isNotNull() & F.col("y").isNotNull()))
    keys = by + ["pid"]
    fit = long_df.groupBy(*keys, "target", "feature").agg(          # names as keys: first() of a string would sort all rows
        F.count(F.lit(1)).alias("n"), F.min("x").alias("vmin"), F.max("x").alias("vmax"),
        F.regr_r2("y", "x").alias("_r2"), F.regr_sxx("y", "x").alias("sxx"), F.regr_syy("y", "x").alias("syy")).cache()
    q = exact_quantiles(long_df, keys, "x", _bin_probs(max_bins), stats=fit.select(*keys, "n", "vmin", "vmax"))
    edges = keyed_join(fit, q.drop("n"), keys).select(
        *keys, "n", "target", "feature",
        F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("_r2")).otherwise(F.lit(0.0)).alias("r2_linear"),
        _n_bins(max_bins).alias("n_bins"), _edges(max_bins).alias("edges"))
    edges = edges.where((F.col("n") >= MIN_ROWS_FOR_NONLINEARITY) & (F.size("edges") >= 2))
    binned = keyed_join(long_df.drop("target", "feature"), edges.select(*keys, "edges"), keys).withColumn(
        "level", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col("x")))).cast("string"))
    lv = binned.groupBy(*keys, "level").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("var_pop"),
        F.min("y").alias("vmin"), F.max("y").alias("vmax"))
    return _step_result(edges, lv, keys, by, min_group_size)


def _bin_probs(max_bins: int) -> list[float]:
    return sorted({round(i / b, 12) for b in range(2, max_bins + 1) for i in range(b + 1)})


def _n_bins(max_bins: int) -> Column:
    return F.least(F.lit(max_bins), F.greatest(F.lit(2), (F.col("n") / 4).cast("long")))


def _edges(max_bins: int) -> Column:
    """Distinct bin edges from ``quantiles`` at :func:`_bin_probs`, for as many bins as ``n`` allows."""
    pos = {p: i for i, p in enumerate(_bin_probs(max_bins))}
    cases = None
    for b in range(2, max_bins + 1):
        arr = F.array(*[F.col("quantiles")[pos[round(i / b, 12)]] for i in range(b + 1)])
        cases = F.when(_n_bins(max_bins) == b, arr) if cases is None else cases.when(_n_bins(max_bins) == b, arr)
    return F.array_distinct(cases)


def _bin_of(x: Column, edges: Column) -> Column:
    """Bin from 1, 0 for a missing value; bins are closed on the right and the first takes in its lower edge."""
    below = F.size(F.filter(F.coalesce(edges, F.array().cast("array<double>")), lambda e: e < x))
    return F.when(x.isNull(), 0).otherwise(F.greatest(F.lit(1), below)).cast("double")


def _step_result(edges: DataFrame, lv: DataFrame, keys: list[str], by: list[str], min_group_size: int) -> DataFrame:
    """ANOVA of the bins of each pair (``pid``) beside its linear fit."""
    lv = lv.withColumn("target", F.col("pid").cast("string")).withColumn("group_col", F.lit("bin"))
    eta = eta_from_levels(lv, keys, min_group_size).drop("target", "group_col", "n")
    out = keyed_join(edges, eta, keys)
    detected = (F.col("reliable") & (F.col("p_value") <= STEP_P_VALUE_THRESHOLD)
                & (F.col("eta_squared") > F.col("r2_linear") + ETA_SQUARED_IMPROVEMENT_THRESHOLD))
    return out.select(*by, "target", "feature", "n", "n_bins", F.col("edges").alias("bin_boundaries"),
                      "r2_linear", F.col("eta_squared").alias("eta_squared_binned"), "p_value", "f_statistic",
                      "reliable", F.coalesce(detected, F.lit(False)).alias("detected"))


def step_patterns(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] | None = None,
                  max_bins: int = 5, min_group_size: int = 5, keep_all: bool = False) -> DataFrame:
    """R5 for (target, feature) pairs: ``by..., target, feature, n, n_bins,
    bin_boundaries, r2_linear, eta_squared_binned, p_value, f_statistic, detected``.

    Up to :data:`DIRECT_PAIRS` pairs rows are expanded to pairs. Beyond, edges are found once per feature, a row
    looks its bins up once per feature, and matrix products sum all targets in all bins; only pairs whose target
    misses where the feature is present (their edges differ from the feature's) are done one by one.
    """
    by, pairs = as_list(by), list(dict.fromkeys(_pairs(pairs)))
    if len(pairs) <= DIRECT_PAIRS:
        out = _step_by_pair(df, pairs, by, max_bins, min_group_size)
    else:
        out = _step_by_feature(df, pairs, by, max_bins, min_group_size)
    return out if keep_all else out.where("detected")


def _step_by_feature(df: DataFrame, pairs: Sequence[tuple[str, str]], by: list[str], max_bins: int, min_group_size: int) -> DataFrame:
    cols = sorted({c for p in pairs for c in p})
    centre = materialize(tiles.centres(df, cols, by))
    sums = _both_ways(materialize(tiles.pair_sums(tiles.standardised(df, cols, by, centre), len(cols), by)), by, False)
    sums = keyed_join(sums.join(F.broadcast(_pair_index(df, cols, pairs)), ["i", "j"]), centre, by)
    partial = [(r["target"], r["feature"]) for r in
               sums.where(F.col("n") < F.col("_n")[F.col("i")]).select("target", "feature").distinct().collect()]   # pairs of columns
    n = F.col("n").cast("double")
    sxx, syy = F.col("s2") - F.col("s1") ** 2 / n, F.col("syy") - F.col("sy") ** 2 / n
    sxy = F.col("szy") - F.col("s1") * F.col("sy") / n
    varied = (F.col("_sd")[F.col("i")] > 0) & (F.col("_sd")[F.col("j")] > 0)
    lost = varied & ((sxx < LOST_DIGITS * F.col("s2")) | (syy < LOST_DIGITS * F.col("syy")))
    partial += [p for r in sums.where(lost).select("target", "feature").distinct().collect() if (p := (r["target"], r["feature"])) not in partial]
    names = F.array(*[F.lit(c) for c in cols])
    # edges of each feature over its own rows, by segment
    long_df = long_numeric(df, cols, by)
    st = long_df.groupBy(*by, "column").agg(F.count("value").alias("n"), F.min("value").alias("vmin"), F.max("value").alias("vmax")).cache()
    q = exact_quantiles(long_df, [*by, "column"], "value", _bin_probs(max_bins), stats=st)
    edges = materialize(keyed_join(st, q.drop("n"), [*by, "column"]).select(*by, "column", _n_bins(max_bins).alias("n_bins"), _edges(max_bins).alias("edges")))
    per_row = edges.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("column", "edges"))).alias("_of"))
    per_row = per_row.select(*by, F.array(*[F.element_at("_of", F.lit(c)) for c in cols]).alias("_edges"))
    bins = F.array(*[_bin_of(F.col(f"_x{i}"), F.col("_edges")[i]) for i in range(len(cols))])
    rows = tiles.standardised(df, cols, by, keyed_join(centre, per_row, by), bins.alias("_bin"))
    lv = materialize(tiles.bin_sums(rows, len(cols), max_bins, by))
    whole = [p for p in pairs if p not in set(partial)]
    index = _pair_index(df, cols, whole).withColumn("pid", (F.col("i") * len(cols) + F.col("j")).cast("int"))
    keys = [*by, "pid"]
    fit = sums.where((F.col("n") == F.col("_n")[F.col("i")]) & (F.col("n") >= MIN_ROWS_FOR_NONLINEARITY)).select(
        *by, "i", "j", "n", F.when(varied, F.try_divide(sxy * sxy, sxx * syy)).otherwise(F.lit(0.0)).alias("r2_linear"), names[F.col("i")].alias("column"))
    fit = keyed_join(fit, edges, by, extra=["column"]).where(F.size("edges") >= 2).join(F.broadcast(index), ["i", "j"])
    lv = lv.select(*by, F.col("k0").alias("i"), F.col("k2").alias("j"), F.col("k1").cast("string").alias("level"), "n",
                   (F.col("s1") / F.col("n")).alias("mean"), (F.col("s2") / F.col("n")).alias("raw"))
    var = F.col("raw") - F.col("mean") ** 2              # equal values leave a rounding error, not a variance
    lv = lv.withColumn("var_pop", F.when(var > 1e-13 * F.col("raw"), var).otherwise(F.lit(0.0))).withColumn("vmin", F.lit(0.0)).withColumn("vmax", F.lit(0.0))
    lv = lv.join(F.broadcast(index.select("i", "j", "pid")), ["i", "j"])
    out = _step_result(fit.drop("i", "j", "column"), lv.drop("i", "j", "raw"), keys, by, min_group_size)
    return out.unionByName(_step_by_pair(df, partial, by, max_bins, min_group_size)) if partial else out


def nonlinearity_scan(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] | None = None,
                      top_k: int = 3, exclude: DataFrame | None = None, among: DataFrame | None = None) -> DataFrame:
    """Quadratic + step on each pair; BH over the quadratic p-values of
    detected patterns (kept at <= 0.10); a kept quadratic hides the step
    result of the same pair; ranked by gain, then p. ``shown`` marks the top k.
    ``exclude`` (``target, feature``, with the keys of ``by`` or for all segments) drops pairs before BH
    (pairs explained by a strong confounder); ``among`` (``by..., column``) lists the columns that each segment scans."""
    by = as_list(by)
    pairs = _pairs(pairs)
    # a row per pair at most; written down, so that the joins below don't copy their long expressions
    quad = materialize(quadratic_patterns(df, pairs, by), None if by else 1)
    step_all = materialize(step_patterns(df, pairs, by), None if by else 1)
    if exclude is not None:
        keys = [*(b for b in by if b in exclude.columns), "target", "feature"]
        ex = exclude.select(*keys).distinct()
        quad, step_all = (keyed_join(x, ex, keys, "left_anti") for x in (quad, step_all))
    for side in ("target", "feature") if among is not None else ():
        each = among.select(*by, F.col("column").alias(side))
        quad, step_all = (keyed_join(x, each, by + [side], "left_semi") for x in (quad, step_all))
    quad = bh_adjust(quad, "p_value", "p_value_adjusted", partition_by=by, tie_break=["target", "feature"])
    quad = quad.where(F.col("p_value_adjusted") <= QUADRATIC_P_VALUE_THRESHOLD)
    q_out = quad.select(*by, "target", "feature", F.lit("quadratic").alias("kind"), "pattern_type",
                        F.col("improvement").alias("gain"), "p_value")
    s_out = step_all.select(*by, "target", "feature", F.lit("step").alias("kind"), F.lit("step").alias("pattern_type"),
                        (F.col("eta_squared_binned") - F.col("r2_linear")).alias("gain"), "p_value")
    s_out = keyed_join(s_out, q_out.select(*by, "target", "feature"), by + ["target", "feature"], "left_anti")
    allp = q_out.unionByName(s_out)
    w = Window.partitionBy(*by).orderBy(F.col("gain").desc(), F.col("p_value").asc(), "target", "feature")
    return allp.withColumn("rank", F.row_number().over(w)).withColumn("shown", F.col("rank") <= top_k)
