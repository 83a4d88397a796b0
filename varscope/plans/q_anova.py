"""Queries: A5, A10-A14 (group effects)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.anova import (confounders, deterministic_rules, eta_squared, segment_rates,
                               significant_subgroups)
from . import oracle_sql as O
from .anova_sql import eta_oracle
from .queries import register, rounded, t


ETA_COLS = ["target", "group_col", "n", "n_groups", "eta_squared", "f_statistic", "p_value", "reliable"]


def _eta_out(df):
    return rounded(df.select(*ETA_COLS), ["eta_squared", "f_statistic", "p_value"])


@register("eta_squared", eta_oracle("orders", ["o_totalprice"], ["o_orderstatus", "o_orderpriority"], 5))
def q_eta_squared(spark, sf):
    """A10: share of o_totalprice variance explained by status / priority."""
    return _eta_out(eta_squared(t(spark, sf, "orders"), "o_totalprice", ["o_orderstatus", "o_orderpriority"]))


@register("anova_f", eta_oracle("part", ["p_retailprice", "p_size"], ["p_type", "p_brand", "p_size"], 5))
def q_anova_f(spark, sf):
    """A10 over several targets and grouping columns at once (one job)."""
    return _eta_out(eta_squared(t(spark, sf, "part"), ["p_retailprice", "p_size"], ["p_type", "p_brand", "p_size"]))


def _flagged(sql: str, thr: float) -> str:
    head, _, tail = sql.rpartition("FROM r WHERE")
    return head + f", NOT (degenerate OR small) AND p <= 0.05 AND eta >= {thr} AS significant FROM r WHERE" + tail


@register("subgroups", _flagged(eta_oracle(
    "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"],
    ["l_returnflag", "l_linestatus"], 2), 0.14))
def q_subgroups(spark, sf):
    """A12 scan over all lineitem measures x text columns with 2..10 levels, with the significance flag."""
    sg = significant_subgroups(t(spark, sf, "lineitem"),
                               ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"],
                               keep_all=True)
    return rounded(sg.select(*ETA_COLS, "significant"), ["eta_squared", "f_statistic", "p_value"])


@register("subgroups_part", eta_oracle(
    "(SELECT *, CAST(floor(p_size / 10) AS BIGINT)::VARCHAR AS size_band FROM part)", ["p_retailprice", "p_size"], ["p_type", "size_band"], 2, where="NOT (degenerate OR small) AND p <= 0.05 AND eta >= 0.14"))
def q_subgroups_part(spark, sf):
    """A12 with the default 0.14 threshold: bands of p_size explain p_size, p_type (6 levels) explains neither measure;
    p_brand has 25 levels, over the limit."""
    part = t(spark, sf, "part").withColumn("size_band", F.floor(F.col("p_size") / 10).cast("bigint").cast("string"))
    return _eta_out(significant_subgroups(part, ["p_retailprice", "p_size"]))


def _confounder_oracle() -> str:
    # orders: target o_totalprice, feature o_custkey; candidates: text columns and <= 10 distinct
    inner = eta_oracle("orders", ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"], 5)
    body, _, _ = inner.rpartition("SELECT target, group_col")
    return body + f"""SELECT 'o_totalprice' AS target, 'o_custkey' AS feature, group_col AS "column",
  {O.sig("max(eta) FILTER (WHERE target = 'o_totalprice')")} AS eta_target,
  {O.sig("max(p) FILTER (WHERE target = 'o_totalprice')")} AS p_target,
  {O.sig("max(eta) FILTER (WHERE target = 'o_custkey')")} AS eta_feature,
  {O.sig("max(p) FILTER (WHERE target = 'o_custkey')")} AS p_feature,
  bool_and(NOT (degenerate OR small) AND p <= 0.05 AND eta >= 0.14) AS is_confounder
FROM r GROUP BY group_col"""


@register("confounders", _confounder_oracle())
def q_confounders(spark, sf):
    """A13 scan: every candidate column with both effects and the confounder flag."""
    o = t(spark, sf, "orders")
    c = confounders(o, "o_totalprice", "o_custkey", keep_all=True)
    return rounded(c, ["eta_target", "p_target", "eta_feature", "p_feature"])


SUPP_NATION = ("(SELECT s.s_acctbal, s.s_nationkey, n.n_name, n.n_regionkey FROM supplier s "
               "JOIN nation n ON n.n_nationkey = s.s_nationkey)")


@register("deterministic", """
SELECT target, 'n_name' AS group_col, bool_and(lo = hi) AS deterministic, count(*) AS n_groups FROM (
  SELECT 's_acctbal' AS target, n_name, min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM {s} GROUP BY n_name
  UNION ALL SELECT 's_nationkey', n_name, min(s_nationkey), max(s_nationkey) FROM {s} GROUP BY n_name
  UNION ALL SELECT 'n_regionkey', n_name, min(n_regionkey), max(n_regionkey) FROM {s} GROUP BY n_name)
GROUP BY target""".replace("{s}", SUPP_NATION))
def q_deterministic(spark, sf):
    """A14 on supplier x nation: the nation name fixes its key and region, not the balance."""
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return deterministic_rules(s, ["s_acctbal", "s_nationkey", "n_regionkey"], ["n_name"])


@register("segment_rates", f"""
SELECT group_col, level, n, {O.sig('rate')} AS rate,
       row_number() OVER (PARTITION BY group_col ORDER BY rate DESC, level) AS rank FROM (
  SELECT 'lang' AS group_col, lang AS level, count(quality) AS n, avg(quality) AS rate
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY lang)""")
def q_segment_rates(spark, sf):
    """A5: labelled-quality rate per language (source has 20 levels, over the limit of 10)."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    return rounded(segment_rates(d, "quality", ["lang", "source"]), ["rate"])


@register("segments", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n_rows,
       concat_ws('_', o_orderstatus, o_orderpriority) AS segment
FROM orders GROUP BY ALL HAVING count(*) >= 3""")
def q_segments(spark, sf):
    """A25 bookkeeping: (status, priority) segments with at least 3 rows."""
    from ..operators.segments import eligible_segments, segment_sizes
    o = t(spark, sf, "orders")
    return segment_sizes(eligible_segments(o, ["o_orderstatus", "o_orderpriority"]),
                         ["o_orderstatus", "o_orderpriority"])
