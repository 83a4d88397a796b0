"""Queries: R4, R5, R10, A15, A17-A24 (shape, distribution, levels, derived columns)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators.derived import FORMS, derived_pairs, derived_relationships
from ..operators.distribution import distribution_profile
from ..operators.levels import level_feature_for_simulation, level_features
from ..operators.shape import nonlinearity_scan, quadratic_patterns, step_patterns
from . import oracle_sql as O
from .anova_sql import eta_oracle
from .queries import register, rounded, t

S = O.sig
PART_PAIRS = [("p_retailprice", "p_partkey"), ("p_retailprice", "p_size")]


def _quad_sql(table: str, pairs: list[tuple[str, str]]) -> str:
    parts = []
    for y, x in pairs:
        parts.append(f"""SELECT '{y}' AS target, '{x}' AS feature, count(*) AS n,
  sum(z) AS s1, sum(z*z) AS s2, sum(z*z*z) AS s3, sum(z*z*z*z) AS s4, sum(yc) AS sy, sum(yc*yc) AS syy,
  sum(z*yc) AS szy, sum(z*z*yc) AS szzy, any_value(sd) AS sd
FROM (SELECT ({x} - mx) / sd AS z, {y} - my AS yc, sd FROM {table},
      (SELECT avg({x}::DOUBLE) AS mx, stddev_samp({x}::DOUBLE) AS sd FROM {table}),
      (SELECT avg({y}::DOUBLE) AS my FROM {table})
      WHERE {x} IS NOT NULL AND {y} IS NOT NULL)""")
    return f"""WITH RECURSIVE st AS ({' UNION ALL '.join(parts)}),
a AS (SELECT *, syy - sy * sy / n AS sst, s2 - s1 * s1 / n AS cxx, szy - s1 * sy / n AS cxy,
   n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det,
   sy * (s2 * s4 - s3 * s3) - s1 * (szy * s4 - s3 * szzy) + s2 * (szy * s3 - s2 * szzy) AS da,
   n * (szy * s4 - szzy * s3) - sy * (s1 * s4 - s3 * s2) + s2 * (s1 * szzy - szy * s2) AS db,
   n * (s2 * szzy - s3 * szy) - s1 * (s1 * szzy - s3 * sy) + sy * (s1 * s3 - s2 * s2) AS dc FROM st),
b AS (SELECT *, da / det AS qa, db / det AS qb, dc / det AS qc FROM a WHERE n >= 10 AND cxx > 0 AND det <> 0),
c AS (SELECT *, CASE WHEN sst > 0 THEN 1 - (sst - cxy * cxy / cxx) / sst ELSE 0 END AS r2l,
   greatest(0, syy - (qa * sy + qb * szy + qc * szzy)) AS sseq FROM b),
d AS (SELECT *, CASE WHEN sst > 0 THEN 1 - sseq / sst ELSE 0 END AS r2q,
   sqrt(greatest(sseq / (n - 3) * (n * s2 - s1 * s1) / det, 0)) AS se FROM c),
e AS (SELECT row_number() OVER () AS rid, *, 1 - (1 - r2l) * (n - 1) / (n - 2) AS r2la,
   1 - (1 - r2q) * (n - 1) / (n - 3) AS r2qa FROM d),
_src AS (SELECT rid, (n - 3) / ((n - 3) + (qc / se) * (qc / se)) AS x, (n - 3) / 2.0 AS a, 0.5 AS b FROM e WHERE se > 0),
{O.incbeta_cte('_src')},
f AS (SELECT e.*, CASE WHEN se > 0 THEN i.ix WHEN qc <> 0 THEN 0.0 ELSE 1.0 END AS p FROM e LEFT JOIN ibeta i ON i.rid = e.rid)
SELECT target, feature, n, {S('r2la', 6)} AS r2_linear_adj, {S('r2qa', 6)} AS r2_quadratic_adj,
  {S('r2qa - r2la', 6)} AS improvement, {S('qc / (sd * sd)', 6)} AS quadratic_coefficient,
  round(CASE WHEN se > 0 THEN qc / se END, 6) + 0.0 AS t_statistic, {S('p', 6)} AS p_value,
  CASE WHEN qc > 0 THEN 'u_curve' ELSE 'optimum' END AS pattern_type,
  (r2qa > r2la AND r2qa - r2la >= 0.04 AND p <= 0.10) AS detected FROM f"""


QUAD_COLS = ["target", "feature", "n", "r2_linear_adj", "r2_quadratic_adj", "improvement",
             "quadratic_coefficient", "t_statistic", "p_value", "pattern_type", "detected"]


def _quad_out(q):
    # t is ~0 for some pairs: compare it on an absolute scale (6 decimals)
    q = rounded(q.select(*QUAD_COLS), [c for c in QUAD_COLS[3:9] if c != "t_statistic"], 6)
    return q.withColumn("t_statistic", F.round("t_statistic", 6) + 0.0)


@register("quadratic", _quad_sql("part", PART_PAIRS))
def q_quadratic(spark, sf):
    """R4 on part: retail price against key (saw-tooth) and size, all pairs in one aggregate."""
    return _quad_out(quadratic_patterns(t(spark, sf, "part"), PART_PAIRS, keep_all=True))


LI_QUAD = [("l_extendedprice", "l_quantity"), ("l_extendedprice", "l_discount"), ("l_tax", "l_discount")]


@register("quadratic_lineitem", _quad_sql("lineitem", LI_QUAD))
def q_quadratic_lineitem(spark, sf):
    """R4 over three lineitem pairs (price is linear in quantity: no quadratic gain)."""
    return _quad_out(quadratic_patterns(t(spark, sf, "lineitem"), LI_QUAD, keep_all=True))


def _step_sql(table: str, y: str, x: str) -> str:
    src = f"""(SELECT {y} AS yv, greatest(1, len(list_filter(e.edges, lambda v: v < {x}))) AS bin
  FROM {table}, (SELECT list_sort(list_distinct(quantile_cont({x}::DOUBLE, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS edges
                 FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) e
  WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"""
    inner = eta_oracle(src, ["yv"], ["bin"], 5)
    body, _, _ = inner.rpartition("SELECT target, group_col")
    return body + f"""SELECT '{y}' AS target, '{x}' AS feature, r.n, k AS n_bins,
  {S('l.r2', 6)} AS r2_linear, {S('eta', 6)} AS eta_squared_binned, {S('p', 6)} AS p_value,
  {S('f', 6)} AS f_statistic, NOT (degenerate OR small) AS reliable,
  (NOT (degenerate OR small) AND p <= 0.05 AND eta > l.r2 + 0.02) AS detected
FROM r, (SELECT CASE WHEN regr_sxx({y}, {x}) > 0 AND regr_syy({y}, {x}) > 0 THEN regr_r2({y}, {x}) ELSE 0 END AS r2
         FROM {table}) l"""


STEP_COLS = ["target", "feature", "n", "n_bins", "r2_linear", "eta_squared_binned", "p_value", "f_statistic",
             "reliable", "detected"]


@register("step_pattern", _step_sql("part", "p_retailprice", "p_partkey"))
def q_step_pattern(spark, sf):
    """Quantile bins of p_partkey explain p_retailprice far better than a line (saw-tooth)."""
    s = step_patterns(t(spark, sf, "part"), [("p_retailprice", "p_partkey")], keep_all=True)
    s = s.withColumn("n_bins", F.size("bin_boundaries") - 1)
    return rounded(s.select(*STEP_COLS), ["r2_linear", "eta_squared_binned", "p_value", "f_statistic"], 6)


@register("step_lineitem", _step_sql("lineitem", "l_extendedprice", "l_quantity"))
def q_step_lineitem(spark, sf):
    """R5 on a linear relation: binning gains nothing over the line."""
    s = step_patterns(t(spark, sf, "lineitem"), [("l_extendedprice", "l_quantity")], keep_all=True)
    s = s.withColumn("n_bins", F.size("bin_boundaries") - 1)
    return rounded(s.select(*STEP_COLS), ["r2_linear", "eta_squared_binned", "p_value", "f_statistic"], 6)


@register("nonlinear_scan")
def q_nonlinear_scan(spark, sf):
    """R10 over all part pairs: quadratic + step, BH on quadratic p, ranked; rows-only check."""
    pairs = [("p_retailprice", "p_partkey"), ("p_retailprice", "p_size"), ("p_size", "p_partkey")]
    r = nonlinearity_scan(t(spark, sf, "part"), pairs)
    return rounded(r, ["gain", "p_value"], 6)


# --------------------------------------------------------------------------- distribution

def _dist_sql(table: str, cols: list[str], select: str, by: str | None = None) -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    grp = f"GROUP BY {by}" if by else ""
    parts = []
    for c in cols:
        parts.append(f"""SELECT {g}'{c}' AS "column", count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std,
  var_samp(v) AS variance, min(v) AS vmin, max(v) AS vmax, count(DISTINCT v) AS n_distinct,
  count(*) FILTER (WHERE v = 0) * 1.0 / count(v) AS zero_ratio, count(*) FILTER (WHERE v > 0) * 1.0 / count(v) AS positive_fraction,
  avg(v) FILTER (WHERE v <> 0) AS nonzero_mean, count(*) FILTER (WHERE v = 0) AS n_zero,
  bool_and(abs(v - round(v)) <= 1e-8) AS integer_like,
  avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5) AS skewness,
  avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3 AS kurtosis,
  quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.95) AS p95
FROM (SELECT {g}{c}::DOUBLE AS v, avg({c}::DOUBLE) OVER ({part}) AS m FROM {table}) WHERE v IS NOT NULL {grp}""")
    flags = """, (n >= 10 AND integer_like AND vmin >= 0 AND n_distinct <= 12 AND vmax <= 30 AND mean > 0 AND mean <= 10
     AND (n_distinct <= 8 OR zero_ratio >= 0.2)) AS is_count_data,
  (n >= 10 AND n_distinct > 2 AND vmin >= 0 AND zero_ratio > 0.45 AND n - n_zero >= 2) AS is_zero_inflated,
  (n >= 10 AND vmin >= 0 AND n_zero < n AND skewness > 1.5 AND kurtosis > 1.0 AND median > 0
     AND (CASE WHEN median > 0 THEN p95 / median ELSE 0 END) >= 5) AS is_heavy_tail,
  CASE WHEN median > 0 THEN p95 / median ELSE 0 END AS tail_ratio,
  CASE WHEN std > 0 THEN abs(mean - median) / std END AS asymmetry"""
    return f"WITH p AS ({' UNION ALL '.join(parts)}), q AS (SELECT *{flags} FROM p) SELECT {g}{select} FROM q"


@register("count_data", _dist_sql("lineitem", ["l_linenumber", "l_quantity", "l_tax"],
                                  f'"column", n, {S("mean")} AS mean, {S("variance")} AS variance, '
                                  f'{S("zero_ratio")} AS zero_ratio, n_distinct, is_count_data'))
def q_count_data(spark, sf):
    """l_linenumber (1..7) is count-like; quantity (50 levels) and tax are not."""
    p = distribution_profile(t(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_tax"], count_to=1000)
    return rounded(p.select("column", "n", "mean", "variance", "zero_ratio", "n_distinct", "is_count_data"),
                   ["mean", "variance", "zero_ratio"])


EVZ = "(SELECT event_type, CASE WHEN value < 60 THEN 0 ELSE value END AS value_z, value FROM events)"


@register("zero_inflation", _dist_sql(EVZ, ["value_z", "value"],
                                      f'"column", n, {S("zero_ratio")} AS zero_ratio, '
                                      f'{S("nonzero_mean")} AS nonzero_mean, n_distinct, is_zero_inflated',
                                      by="event_type"))
def q_zero_inflation(spark, sf):
    """A20 per event type: values under 60 zeroed make a zero-heavy column."""
    ev = t(spark, sf, "events").select(
        "event_type", "value", F.when(F.col("value") < 60, 0.0).otherwise(F.col("value")).alias("value_z"))
    p = distribution_profile(ev, ["value_z", "value"], by=["event_type"])
    return rounded(p.select("event_type", "column", "n", "zero_ratio", "nonzero_mean", "n_distinct",
                            "is_zero_inflated"), ["zero_ratio", "nonzero_mean"])


@register("heavy_tail", _dist_sql("documents", ["n_chars"],
                                  f'"column", n, {S("skewness", 6)} AS skewness, {S("kurtosis", 6)} AS kurtosis, '
                                  f'{S("median")} AS median, {S("p95")} AS p95, {S("tail_ratio")} AS tail_ratio, '
                                  f'{S("positive_fraction")} AS positive_fraction, is_heavy_tail', by="lang"))
def q_heavy_tail(spark, sf):
    """A18 per language on document length (heavy right tail)."""
    p = distribution_profile(t(spark, sf, "documents"), ["n_chars"], by=["lang"], count_to=12)
    p = p.select("lang", "column", "n", "skewness", "kurtosis", "median", "p95", "tail_ratio",
                 "positive_fraction", "is_heavy_tail")
    return rounded(rounded(p, ["median", "p95", "tail_ratio", "positive_fraction"]), ["skewness", "kurtosis"], 6)


@register("asymmetry", _dist_sql("events", ["value", "user_id"],
                                 f'"column", n, {S("asymmetry", 6)} AS asymmetry, '
                                 f'coalesce(asymmetry > 0.4, false) AS is_asymmetric'))
def q_asymmetry(spark, sf):
    """|mean - median| / std > 0.4 on event values and user ids."""
    p = distribution_profile(t(spark, sf, "events"), ["value", "user_id"], count_to=12)
    return rounded(p.select("column", "n", "asymmetry", "is_asymmetric"), ["asymmetry"], 6)


# --------------------------------------------------------------------------- levels

LEVEL_COLS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _level_sql() -> str:
    return _dist_sql("lineitem", LEVEL_COLS, f'''"column", n, n_distinct, {S("std")} AS std,
  {S("(vmax - vmin) / (n_distinct - 1)")} AS mean_gap,
  coalesce(n >= 10 AND NOT is_count_data AND n_distinct >= 2 AND n_distinct <= 25 AND std > 0
    AND n * 1.0 / n_distinct >= 2 AND (vmax - vmin) / (n_distinct - 1) >= 0.1 * std, false) AS is_level_feature''')


@register("level_feature", _level_sql())
def q_level_feature(spark, sf):
    """Discount (11 values) and tax (9) are level-like; quantity has 50 values; linenumber is count data."""
    lf = level_features(t(spark, sf, "lineitem"), LEVEL_COLS, count_to=1000)
    return rounded(lf.select("column", "n", "n_distinct", "std", "mean_gap", "is_level_feature"), ["std", "mean_gap"])


@register("level_target", f"""
WITH f AS ({_dist_sql("lineitem", ["l_discount"], '''n, n_distinct, std, vmax, vmin, is_count_data''')}),
w AS (SELECT avg(s) AS mw FROM (SELECT stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY l_discount HAVING count(l_extendedprice) >= 2)),
g AS (SELECT stddev_samp(l_extendedprice) AS gs FROM lineitem)
SELECT {S('mw / gs')} AS within_ratio,
  coalesce(n >= 10 AND NOT is_count_data AND n_distinct BETWEEN 2 AND 25 AND std > 0 AND n * 1.0 / n_distinct >= 2
    AND (vmax - vmin) / (n_distinct - 1) >= 0.1 * std, false) AND NOT (mw / gs > 0.6) AS is_level_feature
FROM f, w, g""")
def q_level_target(spark, sf):
    """Discount is level-like but price varies as much within a discount level as overall."""
    r = level_feature_for_simulation(t(spark, sf, "lineitem"), "l_discount", "l_extendedprice")
    return rounded(r.select("within_ratio", "is_level_feature"), ["within_ratio"])


# --------------------------------------------------------------------------- derived columns

DER_COLS = ["l_extendedprice", "l_discount", "net", "one_minus_disc", "l_quantity"]
DER_SRC = ("(SELECT l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net, "
           "1 - l_discount AS one_minus_disc, l_quantity FROM lineitem)")


def _derived_sql() -> str:
    parts = []
    for ti, tg in enumerate(DER_COLS):
        others = [c for c in DER_COLS if c != tg]
        for a, b in combinations(others, 2):
            valid = f"{tg} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL"
            sc = f"greatest(abs({tg}), 1e-9)"
            cnt = ", ".join(
                f"count(*) FILTER (WHERE {valid} AND abs({tg} - ({pred})) / {sc} < 0.02) AS {name}"
                for name, pred in zip(FORMS, (f"{a} * {b}", f"{a} + {b}", f"{a} - {b}", f"{b} - {a}")))
            parts.append(f"SELECT '{tg}' AS target, '{a}' AS col_a, '{b}' AS col_b, "
                         f"count(*) FILTER (WHERE {valid}) AS valid, {cnt} FROM {DER_SRC}")
    forms = " UNION ALL ".join(f"SELECT target, col_a, col_b, '{f}' AS form, {f} * 1.0 / valid AS match_share "
                               f"FROM c WHERE valid >= 3" for f in FORMS)
    return (f"WITH c AS ({' UNION ALL '.join(parts)}), m AS ({forms}) "
            f"SELECT target, col_a, col_b, form, {S('match_share')} AS match_share FROM m WHERE match_share > 0.95")


def _der_df(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.select("l_extendedprice", "l_discount",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                     (1 - F.col("l_discount")).alias("one_minus_disc"), "l_quantity")


@register("derived_relationships", _derived_sql())
def q_derived_relationships(spark, sf):
    """net = price * (1 - discount) is found; its components become derived pairs."""
    return rounded(derived_relationships(_der_df(spark, sf), DER_COLS), ["match_share"])


@register("derived_pairs", f"""
WITH r AS ({_derived_sql()}), p AS (SELECT target, col_a AS o FROM r UNION ALL SELECT target, col_b FROM r)
SELECT DISTINCT least(target, o) AS column_a, greatest(target, o) AS column_b FROM p""")
def q_derived_pairs(spark, sf):
    return derived_pairs(_der_df(spark, sf), DER_COLS)
