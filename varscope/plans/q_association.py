"""Queries: A7-A9, T1, T3 (pairwise association)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators.association import correlation_pvalues, pair_stats, top_pairs
from . import oracle_sql as O
from .queries import register, rounded, t

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"]
LI_SRC = ("(SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax, "
          "l_extendedprice * (1 - l_discount) AS net FROM lineitem)")


def _lineitem(spark, sf):
    li = t(spark, sf, "lineitem")
    return li.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))


def corr_oracle(src: str, cols: list[str], by: list[str] | None = None, alpha: float = 0.05,
                top_k: int | None = None) -> str:
    by = by or []
    bysel = "".join(f"{b}, " for b in by)
    grp = f" GROUP BY {', '.join(by)}" if by else ""
    parts = []
    for (i, a), (j, b) in combinations(list(enumerate(cols)), 2):
        parts.append(
            f"SELECT {bysel}'{a}' AS column_a, '{b}' AS column_b, {i} AS idx_a, {j} AS idx_b, "
            f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r "
            f"FROM {src} s{grp}")
    pairs = " UNION ALL ".join(parts)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    sel_by = "".join(f"k.{b}, " for b in by)
    body = f"""WITH RECURSIVE
_pairs AS (SELECT row_number() OVER () AS rid, * FROM ({pairs}) u
           WHERE n >= 3 AND r IS NOT NULL AND NOT isnan(r)),
_src AS (SELECT rid, 1 - r * r AS x, (n - 2) / 2.0 AS a, 0.5 AS b FROM _pairs),
{O.incbeta_cte('_src')},
_p AS (SELECT k.*, CASE WHEN abs(k.r) >= 1 THEN 0.0 ELSE i.ix END AS p_value
       FROM _pairs k JOIN ibeta i ON i.rid = k.rid),
_r AS (SELECT *, count(*) OVER ({part}) AS m,
              row_number() OVER ({part} ORDER BY p_value, idx_a, idx_b) AS rk FROM _p),
_q AS (SELECT *, least(1.0, min(p_value * m / rk) OVER ({part} ORDER BY rk DESC
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p_value_adjusted FROM _r)"""
    sel = (f"SELECT {''.join(f'{b}, ' for b in by)}column_a, column_b, n, {O.sig('r')} AS r, "
           f"{O.sig('p_value')} AS p_value, {O.sig('p_value_adjusted')} AS p_value_adjusted, "
           f"p_value_adjusted < {alpha} AS significant")
    if top_k is None:
        return f"{body}\n{sel} FROM _q"
    return (f"{body},\n_t AS (SELECT *, row_number() OVER ({part} ORDER BY abs(r) DESC, idx_a, idx_b) AS rank FROM _q)\n"
            f"{sel}, rank FROM _t WHERE rank <= {top_k}")


def _finish(df, by=()):
    return rounded(df.select(*by, "column_a", "column_b", "n", "r", "p_value", "p_value_adjusted",
                             "significant"), ["r", "p_value", "p_value_adjusted"])


@register("corr_pvalues", corr_oracle(LI_SRC, LI_COLS))
def q_corr_pvalues(spark, sf):
    """Flagship: all-pairs Pearson r, p and BH over lineitem measures + net revenue."""
    return _finish(correlation_pvalues(_lineitem(spark, sf), LI_COLS))


@register("corr_by_segment", corr_oracle(LI_SRC, LI_COLS, by=["l_returnflag"]))
def q_corr_by_segment(spark, sf):
    return _finish(correlation_pvalues(_lineitem(spark, sf), LI_COLS, by=["l_returnflag"]), ["l_returnflag"])


@register("top_pairs", corr_oracle(LI_SRC, LI_COLS, by=["l_returnflag"], top_k=3))
def q_top_pairs(spark, sf):
    pv = correlation_pvalues(_lineitem(spark, sf), LI_COLS, by=["l_returnflag"])
    tp = top_pairs(pv, k=3, by=["l_returnflag"])
    return rounded(tp.select("l_returnflag", "column_a", "column_b", "n", "r", "p_value",
                             "p_value_adjusted", "significant", "rank"),
                   ["r", "p_value", "p_value_adjusted"])


ORD_COLS = ["o_totalprice", "o_custkey", "o_orderkey"]


@register("corr_pairs", f"""
SELECT column_a, column_b, n, {O.sig('r')} AS r FROM (
  SELECT 'o_totalprice' AS column_a, 'o_custkey' AS column_b, count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL) AS n, corr(o_totalprice, o_custkey) AS r FROM orders
  UNION ALL SELECT 'o_totalprice', 'o_orderkey', count(*) FILTER (WHERE o_totalprice IS NOT NULL AND o_orderkey IS NOT NULL), corr(o_totalprice, o_orderkey) FROM orders
  UNION ALL SELECT 'o_custkey', 'o_orderkey', count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL), corr(o_custkey, o_orderkey) FROM orders)""")
def q_corr_pairs(spark, sf):
    """Pairwise-complete n and r (A7 in pair form) on orders."""
    ps = pair_stats(t(spark, sf, "orders"), ORD_COLS)
    return rounded(ps.select("column_a", "column_b", "n", "r"), ["r"])


LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "net"]
LI_ALL_SRC = ("(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, "
              "l_discount, l_tax, l_extendedprice * (1 - l_discount) AS net FROM lineitem)")


@register("corr_gram", corr_oracle(LI_ALL_SRC, LI_ALL))
def q_corr_gram(spark, sf):
    """A8/A9 over all numeric columns of lineitem, keys included: 36 pairs, one scan."""
    return _finish(correlation_pvalues(_lineitem(spark, sf), LI_ALL))


# A constant column, a column that is constant in one segment only, and one that is always NULL.
CONST_COLS = ["l_quantity", "l_tax", "fixed", "flat_in_r", "missing"]
CONST_SRC = ("(SELECT l_returnflag, l_quantity, l_tax, 7.25::DOUBLE AS fixed, CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE l_discount END AS flat_in_r, "
             "NULL::DOUBLE AS missing FROM lineitem)")


def const_oracle() -> str:
    # DuckDB's corr of a constant is NaN or an error by version: leave such pairs out by min = max
    def guarded(a, b):
        both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
        return (f"SELECT l_returnflag, '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {both}) AS n, "
                f"CASE WHEN count(*) FILTER (WHERE {both}) >= 3 AND min({a}) FILTER (WHERE {both}) < max({a}) FILTER (WHERE {both}) "
                f"AND min({b}) FILTER (WHERE {both}) < max({b}) FILTER (WHERE {both}) THEN {O.sig(f'covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b}))')} END AS r "
                f"FROM {CONST_SRC} s GROUP BY l_returnflag")
    return " UNION ALL ".join(guarded(a, b) for a, b in combinations(CONST_COLS, 2))


@register("corr_constants", const_oracle())
def q_corr_constants(spark, sf):
    """A7/A8 by segment with a constant, a partly constant and an empty column: such pairs have no r."""
    li = t(spark, sf, "lineitem").withColumns({
        "fixed": F.lit(7.25), "flat_in_r": F.when(F.col("l_returnflag") == "R", 0.1).otherwise(F.col("l_discount")),
        "missing": F.lit(None).cast("double")})
    ps = pair_stats(li, CONST_COLS, by=["l_returnflag"])
    return rounded(ps.select("l_returnflag", "column_a", "column_b", "n", "r"), ["r"])


# 60 columns: powers and products of the four measures, 1770 pairs.
WIDE = {f"w{i}": (("l_quantity", "l_extendedprice", "l_discount", "l_tax")[i % 4], 0.5 + (i // 4) * 0.1) for i in range(60)}
WIDE_SRC = "(SELECT " + ", ".join(f"pow({c}, {e}::DOUBLE) AS {w}" for w, (c, e) in WIDE.items()) + " FROM lineitem)"


# The pairs of the first and the last column one by one, the others in long form.
WIDE_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
    f"{O.sig(f'corr({a}, {b})', 6)} AS r FROM {WIDE_SRC} s" for a, b in combinations(list(WIDE), 2) if a == "w0" or b == "w59")
WIDE_REST_SQL = f"""
SELECT 'w' || i AS column_a, 'w' || j AS column_b, n, {O.sig('c', 6)} AS r FROM (
  SELECT i, j, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n, corr(x, y) AS c FROM (
    SELECT i, j, v[i + 1] AS x, v[j + 1] AS y FROM (SELECT [{', '.join(WIDE)}] AS v FROM {WIDE_SRC} s),
      (SELECT a.i AS i, b.i AS j FROM range(1, {len(WIDE) - 1}) a(i), range(1, {len(WIDE) - 1}) b(i) WHERE a.i < b.i))
  GROUP BY i, j)"""


@register("corr_wide", f"{WIDE_SQL} UNION ALL {WIDE_REST_SQL}")
def q_corr_wide(spark, sf):
    """A7 on 60 columns: all 1770 pairs are computed, returned and compared."""
    li = t(spark, sf, "lineitem").select(*[F.pow(c, F.lit(e)).alias(w) for w, (c, e) in WIDE.items()])
    return rounded(pair_stats(li).select("column_a", "column_b", "n", "r"), ["r"], 6)


def _matrix_sql() -> str:
    cols = ["o_totalprice", "o_custkey", "o_orderkey"]
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, 1.0 AS r")
            else:
                parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {O.sig(f'corr({a}, {b})')} AS r FROM orders")
    return " UNION ALL ".join(parts)


@register("corr_matrix", _matrix_sql())
def q_corr_matrix(spark, sf):
    """The square Pearson matrix in long form (both orders and the diagonal)."""
    from ..operators.association import correlation_matrix
    m = correlation_matrix(t(spark, sf, "orders"), ORD_COLS)
    return rounded(m, ["r"])
