"""SQL building blocks for the DuckDB oracle of ``oracle_sql()``.

DuckDB has no beta function; p-values are computed with the Lentz continued
fraction of the regularised incomplete beta in a recursive CTE, evaluated
only on the aggregated rows of the oracle query.
"""

from __future__ import annotations


def sig(expr: str, digits: int = 8) -> str:
    """Round to ``digits`` significant digits (same arithmetic as ``plans.queries.sig``)."""
    x = f"({expr})"
    sc = f"({digits - 1} - floor(log10(abs{x})))"
    k = (f"round(CASE WHEN {sc} >= 0 THEN {x} * power(10.0, {sc}) "
         f"ELSE {x} / power(10.0, -{sc}) END)")
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN {x} "
            f"WHEN abs{x} < 1e-15 THEN 0.0 "
            f"WHEN {sc} >= 0 THEN {k} / power(10.0, {sc}) ELSE {k} * power(10.0, -{sc}) END)")


def incbeta_cte(source: str, name: str = "ibeta") -> str:
    """CTE text defining ``name(rid, ix)`` = I_x(a, b) for every row of
    ``source(rid, x, a, b)`` (a named relation). Use inside ``WITH RECURSIVE``."""
    g = "(CASE WHEN abs({v}) < 1e-300 THEN 1e-300 ELSE {v} END)"
    return f"""
_ib_in AS (
  SELECT rid, x, a, b, (x >= (a + 1) / (a + b + 2)) AS flip FROM {source}
  WHERE x > 0 AND x < 1 AND a > 0 AND b > 0),
_ib_p AS (
  SELECT rid, flip,
         CASE WHEN flip THEN 1 - x ELSE x END AS xx,
         CASE WHEN flip THEN b ELSE a END AS aa,
         CASE WHEN flip THEN a ELSE b END AS bb FROM _ib_in),
_ib_cf(rid, m, c, d, h, xx, aa, bb, fin) AS (
  SELECT rid, 0, 1.0::DOUBLE,
         1.0 / {g.format(v="1 - (aa + bb) * xx / (aa + 1)")},
         1.0 / {g.format(v="1 - (aa + bb) * xx / (aa + 1)")},
         xx, aa, bb, false FROM _ib_p
  UNION ALL
  SELECT rid, m1, c2, d2, h * d1 * c1 * d2 * c2, xx, aa, bb, abs(d2 * c2 - 1) < 1e-15
  FROM (
    SELECT rid, m1, xx, aa, bb, h, d1, c1,
           1.0 / {g.format(v="1 + e2 * d1")} AS d2,
           {g.format(v="1 + e2 / c1")} AS c2
    FROM (
      SELECT rid, m1, xx, aa, bb, h, d1, c1,
             -(aa + m1) * (aa + bb + m1) * xx / ((aa + 2 * m1) * (aa + 1 + 2 * m1)) AS e2
      FROM (
        SELECT rid, m + 1 AS m1, xx, aa, bb, h,
               1.0 / {g.format(v="1 + e1 * d")} AS d1,
               {g.format(v="1 + e1 / c")} AS c1
        FROM (
          SELECT *, (m + 1) * (bb - (m + 1)) * xx / ((aa - 1 + 2 * (m + 1)) * (aa + 2 * (m + 1))) AS e1
          FROM _ib_cf WHERE NOT fin AND m < 20000) s0) s1) s2) s3),
_ib_last AS (
  SELECT rid, arg_max(h, m) AS h, any_value(xx) AS xx, any_value(aa) AS aa, any_value(bb) AS bb
  FROM _ib_cf GROUP BY rid),
{name} AS (
  SELECT s.rid,
         CASE WHEN s.x <= 0 THEN 0.0 WHEN s.x >= 1 THEN 1.0
              ELSE (CASE WHEN i.flip THEN 1 - v.fr ELSE v.fr END) END AS ix
  FROM {source} s
  LEFT JOIN _ib_in i ON i.rid = s.rid
  LEFT JOIN (
    SELECT rid, exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * ln(xx) + bb * ln(1 - xx)) * h / aa AS fr
    FROM _ib_last) v ON v.rid = s.rid)"""
