"""Oracle SQL for one-way ANOVA (shared by several queries)."""

from __future__ import annotations

from . import oracle_sql as O


def eta_oracle(src: str, targets: list[str], group_cols: list[str], min_group_size: int,
               where: str = "TRUE") -> str:
    lv = " UNION ALL ".join(
        f"SELECT '{tg}' AS target, '{g}' AS group_col, {g}::VARCHAR AS level, count({tg}) AS n, "
        f"avg({tg}::DOUBLE) AS mean, var_pop({tg}::DOUBLE) AS var_pop, min({tg}) AS vmin, max({tg}) AS vmax "
        f"FROM {src} s WHERE {g} IS NOT NULL GROUP BY {g}"
        for tg in targets for g in group_cols)
    return f"""WITH RECURSIVE
lv AS ({lv}),
g AS (SELECT target, group_col, sum(n) FILTER (WHERE n > 0) AS n, count(*) FILTER (WHERE n > 0) AS k,
             min(n) FILTER (WHERE n > 0) AS min_size,
             sum(n * mean) FILTER (WHERE n > 0) / sum(n) FILTER (WHERE n > 0) AS grand,
             coalesce(sum(n * var_pop) FILTER (WHERE n > 0), 0) AS ssw
      FROM lv GROUP BY target, group_col),
s AS (SELECT g.*, coalesce((SELECT sum(l.n * (l.mean - g.grand) * (l.mean - g.grand)) FROM lv l
               WHERE l.target = g.target AND l.group_col = g.group_col AND l.n > 0), 0) AS ssb FROM g),
c AS (SELECT row_number() OVER () AS rid, *, (n IS NULL OR k < 2 OR n <= k) AS degenerate,
             min_size < {min_group_size} AS small,
             ssb / (k - 1) AS msb, ssw / (n - k) AS msw FROM s),
_src AS (SELECT rid, (n - k) / ((n - k) + (k - 1) * (msb / msw)) AS x, (n - k) / 2.0 AS a, (k - 1) / 2.0 AS b
         FROM c WHERE NOT degenerate AND NOT small AND msw > 0),
{O.incbeta_cte('_src')},
r AS (
  SELECT c.*,
    CASE WHEN degenerate THEN 0.0 WHEN ssb + ssw > 0 THEN greatest(0.0, least(1.0, ssb / (ssb + ssw))) ELSE 0.0 END AS eta,
    CASE WHEN degenerate OR small THEN 0.0 WHEN msw = 0 THEN (CASE WHEN ssb > 0 THEN 'inf'::DOUBLE ELSE 0.0 END)
         ELSE msb / msw END AS f,
    CASE WHEN degenerate OR small THEN 1.0 WHEN msw = 0 THEN (CASE WHEN ssb > 0 THEN 0.0 ELSE 1.0 END)
         ELSE i.ix END AS p
  FROM c LEFT JOIN ibeta i ON i.rid = c.rid)
SELECT target, group_col, n, k AS n_groups, {O.sig('eta')} AS eta_squared, {O.sig('f')} AS f_statistic,
       {O.sig('p')} AS p_value, NOT (degenerate OR small) AS reliable FROM r WHERE {where}"""
