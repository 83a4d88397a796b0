"""Queries: R1-R3, R6-R9, P7, Q1-Q4 (models, influence, what-if)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.influence import cooks_distance, influential_points
from ..operators.regression import fit_simple_regression, logistic, ols_multi, ols_simple, one_hot
from ..operators.whatif import cross_validation, scenario_table, simulate
from . import oracle_sql as O
from .queries import register, rounded, t

S = O.sig


def _ols_sql(by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {g}'l_extendedprice' AS target, 'l_quantity' AS feature,
  regr_count(l_extendedprice, l_quantity) AS n,
  {S('regr_slope(l_extendedprice, l_quantity)')} AS slope,
  {S('regr_intercept(l_extendedprice, l_quantity)')} AS intercept,
  {S('regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) * regr_syy(l_extendedprice, l_quantity))')} AS r_squared,
  'ok' AS status FROM lineitem{grp}"""


OLS_COLS = ["target", "feature", "n", "slope", "intercept", "r_squared", "status"]


@register("ols_simple", _ols_sql(None))
def q_ols_simple(spark, sf):
    r = ols_simple(t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(r.select(*OLS_COLS), ["slope", "intercept", "r_squared"])


@register("ols_by_segment", _ols_sql("l_returnflag"))
def q_ols_by_segment(spark, sf):
    r = ols_simple(t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", by=["l_returnflag"])
    return rounded(r.select("l_returnflag", *OLS_COLS), ["slope", "intercept", "r_squared"])


def _multi_sql(table: str, y: str, x1: str, x2: str) -> str:
    return f"""WITH m AS (SELECT count(*) AS n, avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,
  var_samp({x1}) AS c11, var_samp({x2}) AS c22, covar_samp({x1}, {x2}) AS c12,
  covar_samp({x1}, {y}) AS c1y, covar_samp({x2}, {y}) AS c2y, var_samp({y}) AS cyy
  FROM {table} WHERE {x1} IS NOT NULL AND {x2} IS NOT NULL AND {y} IS NOT NULL),
b AS (SELECT *, (c22 * c1y - c12 * c2y) / (c11 * c22 - c12 * c12) AS b1,
             (c11 * c2y - c12 * c1y) / (c11 * c22 - c12 * c12) AS b2,
             abs(c12) / sqrt(c11 * c22) AS ar FROM m)
SELECT '{y}' AS target, n, {S('my - b1 * m1 - b2 * m2')} AS intercept, {S('b1')} AS coef_1, {S('b2')} AS coef_2,
  {S('(b1 * c1y + b2 * c2y) / cyy')} AS r_squared,
  {S('sqrt(greatest(n, (n - 1) * (1 + ar)) / least(n, (n - 1) * (1 - ar)))', 6)} AS condition_number,
  sqrt(greatest(n, (n - 1) * (1 + ar)) / least(n, (n - 1) * (1 - ar))) > 30 AS multicollinearity_warning,
  'ok' AS status FROM b"""


def _multi_out(r, x1, x2):
    r = r.select("target", "n", "intercept", F.col("coefficients")[x1].alias("coef_1"),
                 F.col("coefficients")[x2].alias("coef_2"), "r_squared", "condition_number",
                 "multicollinearity_warning", "status")
    return rounded(rounded(r, ["intercept", "coef_1", "coef_2", "r_squared"]), ["condition_number"], 6)


@register("ols_multi", _multi_sql("lineitem", "l_extendedprice", "l_quantity", "l_discount"))
def q_ols_multi(spark, sf):
    """R2: price ~ quantity + discount with r^2 and the condition number."""
    r = ols_multi(t(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return _multi_out(r, "l_quantity", "l_discount")


NET_SQL = ("(SELECT l_extendedprice * (1 - l_discount) AS net, l_extendedprice, "
           "l_extendedprice * (1 - l_discount / 2) AS half_net FROM lineitem)")


@register("condition_number", _multi_sql(NET_SQL, "net", "l_extendedprice", "half_net").replace(
    f"{S('my - b1 * m1 - b2 * m2')} AS intercept", "round(my - b1 * m1 - b2 * m2, 4) + 0.0 AS intercept"))
def q_condition_number(spark, sf):
    """R2 on strongly correlated features: net = 2 * half_net - price exactly; condition number > 30."""
    li = t(spark, sf, "lineitem")
    df = li.select("l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
                   (F.col("l_extendedprice") * (1 - F.col("l_discount") / 2)).alias("half_net"))
    out = _multi_out(ols_multi(df, "net", ["l_extendedprice", "half_net"]), "l_extendedprice", "half_net")
    # the exact intercept is 0: compare it on an absolute scale, not on rounding noise
    return out.withColumn("intercept", F.round("intercept", 4) + 0.0)


def _labelled(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(t(spark, sf, "labels"), "doc_id")


def _logistic_sql(target: str, select: str, by: str | None = None) -> str:
    """Plain Newton steps by a recursive CTE on the standardised feature; no fit here comes near the bounds."""
    g, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    on = f" USING ({by})" if by else " ON true"
    grp = f"GROUP BY {by}" if by else ""
    return f"""WITH RECURSIVE d AS (SELECT {g}{target}::DOUBLE AS y0, n_chars::DOUBLE AS x FROM documents JOIN labels USING (doc_id)
  WHERE {target} IS NOT NULL AND n_chars IS NOT NULL),
u AS (SELECT {g}CASE WHEN y0 = max(y0) OVER w THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
  (x - avg(x) OVER w) / stddev_pop(x) OVER w AS u, avg(x) OVER w AS m, stddev_pop(x) OVER w AS s FROM d WINDOW w AS ({part})),
start AS (SELECT {g}0.0::DOUBLE AS a, 0.0::DOUBLE AS c FROM u {grp or "LIMIT 1"}),
it AS (SELECT 0 AS k, * FROM start
  UNION ALL
  SELECT k + 1, {g}a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), c + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, {g}a, c, sum(y - p) AS g0, sum((y - p) * u) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * u) AS h01,
          sum(p * (1 - p) * u * u) AS h11
        FROM (SELECT k, {g}a, c, y, u, 1 / (1 + exp(-(a + c * u))) AS p FROM it JOIN u{on} WHERE k < 15)
        GROUP BY k, {g}a, c)),
f AS (SELECT {g}y, m, s, a, c, a + c * u AS z, 1 / (1 + exp(-(a + c * u))) AS p FROM it JOIN u{on} WHERE k = 15),
r AS (SELECT {g}count(*) AS n, any_value(a) - any_value(c) / any_value(s) * any_value(m) AS b0, any_value(c) / any_value(s) AS b1,
  sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, avg(y) AS ybar, avg(abs(p - y)) AS calibration FROM f {grp})
SELECT {g}'{target}' AS target, 'n_chars' AS feature, n, {O.sig('b0', 6)} AS intercept, {O.sig('b1', 6)} AS coefficient,
  {O.sig('1 - ll / (n * (ybar * ln(ybar) + (1 - ybar) * ln(1 - ybar)))', 6)} AS r_squared, {select}, true AS converged FROM r"""


@register("logistic", _logistic_sql("quality", f"{O.sig('-ll / n', 6)} AS log_loss, {O.sig('calibration', 6)} AS calibration_error"))
def q_logistic(spark, sf):
    """Quality ~ n_chars on labelled documents (damped Newton over the box)."""
    r = logistic(_labelled(spark, sf), "quality", "n_chars")
    return rounded(r.select("target", "feature", "n", "intercept", "coefficient", "r_squared", "log_loss",
                            "calibration_error", "converged"),
                   ["intercept", "coefficient", "r_squared", "log_loss", "calibration_error"], 6)


@register("logistic_by_segment", _logistic_sql("toxic", "'logistic' AS model_type", "lang"))
def q_logistic_by_segment(spark, sf):
    """R3 per language, all segments fitted by the same per-iteration aggregates."""
    r = fit_simple_regression(_labelled(spark, sf), "toxic", "n_chars", by=["lang"])
    return rounded(r.select("lang", "target", "feature", "n", "intercept", "coefficient", "r_squared",
                            "model_type", "converged"), ["intercept", "coefficient", "r_squared"], 6)


def _cooks_sql(where: str, cols: str) -> str:
    return f"""WITH f AS (SELECT regr_count(l_extendedprice, l_quantity) AS n, regr_slope(l_extendedprice, l_quantity) AS b,
    regr_intercept(l_extendedprice, l_quantity) AS a, regr_avgx(l_extendedprice, l_quantity) AS mx,
    regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy,
    regr_sxy(l_extendedprice, l_quantity) AS sxy FROM lineitem),
d AS (SELECT l.l_orderkey, l.l_linenumber, l.l_quantity AS x, l.l_extendedprice AS y, f.n,
    (l.l_extendedprice - (f.a + f.b * l.l_quantity)) AS e,
    1.0 / f.n + (l.l_quantity - f.mx) * (l.l_quantity - f.mx) / f.sxx AS h,
    greatest(0, f.syy - f.sxy * f.sxy / f.sxx) / (f.n - 2) AS mse FROM lineitem l, f),
c AS (SELECT *, e * e / (2 * mse) * h / ((1 - h) * (1 - h)) AS cooks_d, 4.0 / n AS threshold FROM d)
{cols} FROM c {where}"""


@register("influential", _cooks_sql(
    "WHERE cooks_d > threshold",
    f"SELECT l_orderkey, l_linenumber, x, y, {S('cooks_d')} AS cooks_d"))
def q_influential(spark, sf):
    """R7 rows: lineitem lines whose Cook's distance on price ~ quantity exceeds 4/n."""
    rows, _ = influential_points(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice",
                                 key_cols=["l_orderkey", "l_linenumber"])
    return rounded(rows.select("l_orderkey", "l_linenumber", "x", "y", "cooks_d"), ["cooks_d"])


@register("cooks", _cooks_sql(
    "", f"""SELECT any_value(n) AS n, {S('any_value(threshold)')} AS threshold, {S('max(cooks_d)')} AS max_distance,
  count(*) FILTER (WHERE cooks_d > threshold) AS n_influential,
  {S('sum(cooks_d)')} AS total_distance"""))
def q_cooks(spark, sf):
    """R6/R7 summary over every row: n, 4/n, max and sum of D, count above the threshold."""
    li = t(spark, sf, "lineitem")
    cd = cooks_distance(li, "l_quantity", "l_extendedprice", key_cols=["l_orderkey", "l_linenumber"])
    out = cd.agg(F.first("n").alias("n"), F.first(4.0 / F.col("n")).alias("threshold"),
                 F.max("cooks_d").alias("max_distance"),
                 F.count(F.when(F.col("cooks_d") > 4.0 / F.col("n"), 1)).alias("n_influential"),
                 F.sum("cooks_d").alias("total_distance"))
    return rounded(out, ["threshold", "max_distance", "total_distance"])


PCTS = [-0.2, -0.1, 0.05, 0.1, 0.25]


def _whatif_sql(by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    pcts = ", ".join(f"({i}, {p}::DOUBLE)" for i, p in enumerate(PCTS))
    return f"""WITH f AS (SELECT {g}regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b,
    regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) * regr_syy(l_extendedprice, l_quantity)) AS r2,
    sqrt(greatest(0, regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)) / regr_count(l_extendedprice, l_quantity)) AS rs,
    avg(l_quantity) AS ref, stddev_samp(l_extendedprice) AS tstd FROM lineitem{grp}),
s AS (SELECT * FROM (VALUES {pcts}) v(scenario_id, change_pct)),
g AS (SELECT f.*, s.*, a + b * ref AS base, a + b * ref * (1 + change_pct) AS sim FROM f, s)
SELECT {g}scenario_id, change_pct, {S('r2')} AS r_squared, {S('ref')} AS reference_value, {S('base')} AS baseline,
  {S('sim')} AS simulated,
  {S('CASE WHEN tstd = 0 OR abs(base) >= 0.1 * tstd THEN (sim - base) / base * 100 END', 6)} AS change_pct_result,
  (tstd = 0 OR abs(base) >= 0.1 * tstd) AS change_pct_reliable, r2 >= 0.01 AS actionable,
  {S('sim - 1.28 * rs')} AS interval_lower, {S('sim + 1.28 * rs')} AS interval_upper FROM g"""


WHATIF_COLS = ["scenario_id", "change_pct", "r_squared", "reference_value", "baseline", "simulated",
               "change_pct_result", "change_pct_reliable", "actionable", "interval_lower", "interval_upper"]


def _whatif_out(r, by=()):
    r = r.select(*by, *WHATIF_COLS)
    r = rounded(r, ["r_squared", "reference_value", "baseline", "simulated", "interval_lower", "interval_upper"])
    return rounded(r, ["change_pct_result"], 6)


@register("whatif_grid", _whatif_sql(None))
def q_whatif_grid(spark, sf):
    """Five percent-change scenarios of quantity on price, with the 80 % interval."""
    li = t(spark, sf, "lineitem")
    sc = scenario_table(spark, PCTS)
    return _whatif_out(simulate(li, "l_extendedprice", "l_quantity", sc, with_levels=False))


@register("whatif_by_segment", _whatif_sql("l_returnflag"))
def q_whatif_by_segment(spark, sf):
    """The same scenario grid for every return-flag segment in one job."""
    li = t(spark, sf, "lineitem")
    sc = scenario_table(spark, PCTS)
    return _whatif_out(simulate(li, "l_extendedprice", "l_quantity", sc, by=["l_returnflag"], with_levels=False),
                       ["l_returnflag"])


@register("whatif_levels")
def q_whatif_levels(spark, sf):
    """Q2 with the level-feature check (A23) on discount -> price; rows-only check."""
    li = t(spark, sf, "lineitem")
    sc = scenario_table(spark, [0.1], bounds=(0.0, 50000.0))
    r = simulate(li, "l_extendedprice", "l_discount", sc)
    return rounded(r.select("scenario_id", "r_squared", "baseline", "simulated", "bounds_applied", "actionable",
                            "non_actionable_reason"), ["r_squared", "baseline", "simulated"], 6)


@register("cv_folds", f"""
WITH tot AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, regr_slope(l_extendedprice, l_quantity) AS b0,
                    regr_intercept(l_extendedprice, l_quantity) AS a0, count(*) AS n FROM lineitem),
r AS (SELECT l_orderkey % 5 AS fold, l_quantity - mx AS x, l_extendedprice - my AS y,
             l_extendedprice - (a0 + b0 * l_quantity) AS e FROM lineitem, tot),
fo AS (SELECT fold, count(*) AS m, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy,
              sum(x * y) AS sxy, sum(abs(e)) AS sabs, sum(e * e) AS ssq FROM r GROUP BY fold),
tt AS (SELECT sum(m) AS tm, sum(sx) AS tsx, sum(sy) AS tsy, sum(sxx) AS tsxx, sum(sxy) AS tsxy,
              sum(sabs) AS tabs, sum(ssq) AS tsq FROM fo),
tr AS (SELECT fo.*, tt.*, (tsx - sx) / (tm - m) AS mxt, (tsy - sy) / (tm - m) AS myt FROM fo, tt),
fit AS (SELECT *, ((tsxy - sxy) - (tm - m) * mxt * myt) / ((tsxx - sxx) - (tm - m) * mxt * mxt) AS b FROM tr),
ab AS (SELECT *, myt - b * mxt AS a FROM fit),
q AS (SELECT *, CASE WHEN syy - sy * sy / m > 0 THEN 1 - (syy - 2 * a * sy - 2 * b * sxy + m * a * a + 2 * a * b * sx + b * b * sxx) / (syy - sy * sy / m) ELSE 0 END AS r2 FROM ab)
SELECT any_value(tm) AS n, {S('greatest(0, avg(r2))', 6)} AS cv_r2_mean, count(*) AS folds_used,
       {S('any_value(tabs) / any_value(tm)', 6)} AS train_mae, {S('sqrt(any_value(tsq) / any_value(tm))', 6)} AS train_rmse FROM q""")
def q_cv_folds(spark, sf):
    """5-fold test R^2 with folds l_orderkey % 5, from per-fold centred sums."""
    li = t(spark, sf, "lineitem").withColumn("fold", F.col("l_orderkey") % 5)
    cv = cross_validation(li, "l_extendedprice", "l_quantity", fold_col="fold")
    return rounded(cv, ["cv_r2_mean", "train_mae", "train_rmse"], 6)


@register("cv_hashed")
def q_cv_hashed(spark, sf):
    """R9 with content-hashed folds over (orderkey, linenumber); rows-only check."""
    cv = cross_validation(t(spark, sf, "lineitem"), "l_extendedprice", "l_quantity",
                          key_cols=["l_orderkey", "l_linenumber"])
    return rounded(cv, ["cv_r2_mean", "train_mae", "train_rmse"], 6)


@register("one_hot", """
SELECT o_orderkey, o_totalprice,
  CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS o_orderstatus_O,
  CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS o_orderstatus_P,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_2-HIGH",
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_3-MEDIUM",
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_4-NOT SPECIFIED",
  CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_5-LOW"
FROM orders""")
def q_one_hot(spark, sf):
    """Status and priority become 0/1 columns, first sorted level dropped."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return one_hot(o)


@register("interval_logistic")
def q_interval_logistic(spark, sf):
    """R8 for a 0/1 target: logistic projection, interval clipped to [0, 1], percentage points."""
    sc = scenario_table(spark, [-0.5, 0.5])
    r = simulate(_labelled(spark, sf), "quality", "n_chars", sc, with_levels=False)
    return rounded(r.select("scenario_id", "model_type", "baseline", "simulated", "change_percentage_points",
                            "change_pct_reliable", "interval_lower", "interval_upper"),
                   ["baseline", "simulated", "change_percentage_points", "interval_lower", "interval_upper"], 6)
