"""Queries: A1-A4, A6, A17, P3, P4, P8 (profile, quality, schema, outliers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.anomaly import iqr_bounds, iqr_outliers
from ..operators.profile import column_profile, describe
from ..operators.quality import duplicate_count, duplicate_rows, null_counts, validate_dataset
from ..operators.schema import column_types
from . import oracle_sql as O
from .queries import register, rounded, t

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _doc_labels(spark, sf):
    """documents LEFT JOIN labels: unlabeled documents carry NULL labels."""
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = t(spark, sf, "labels")
    return d.join(lab, "doc_id", "left")


DOC_LABELS_SQL = ("(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                  "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)")


def _describe_sql(table: str, cols: list[str]) -> str:
    parts = [f"SELECT '{c}' AS \"column\", count({c}) AS n, {O.sig(f'avg({c}::DOUBLE)')} AS mean, "
             f"{O.sig(f'stddev_samp({c}::DOUBLE)')} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
             f"{O.sig(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median FROM {table}" for c in cols]
    return " UNION ALL ".join(parts)


@register("describe", _describe_sql("lineitem", LI_NUM + ["l_linenumber"]))
def q_describe(spark, sf):
    d = describe(t(spark, sf, "lineitem"), LI_NUM + ["l_linenumber"])
    return rounded(d.select("column", "n", "mean", "std", "min", "max", "median"), ["mean", "std", "median"])


def _profile_sql() -> str:
    parts = []
    for c in ["value", "user_id"]:
        parts.append(f"""SELECT event_type, '{c}' AS \"column\", count(v) AS n, {O.sig('avg(v)')} AS mean,
  {O.sig('stddev_samp(v)')} AS std, min(v) AS vmin, max(v) AS vmax, count(DISTINCT v) AS n_distinct,
  {O.sig('count(*) FILTER (WHERE v = 0) / count(v)')} AS zero_ratio,
  {O.sig('avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5)', 6)} AS skewness,
  {O.sig('avg(power(v - m, 4)) / power(avg(power(v - m, 2)), 2) - 3', 6)} AS kurtosis,
  {O.sig('quantile_cont(v, 0.25)')} AS q25, {O.sig('quantile_cont(v, 0.5)')} AS q50,
  {O.sig('quantile_cont(v, 0.75)')} AS q75, {O.sig('quantile_cont(v, 0.95)')} AS q95
FROM (SELECT event_type, {c}::DOUBLE AS v, avg({c}::DOUBLE) OVER (PARTITION BY event_type) AS m FROM events)
GROUP BY event_type""")
    return " UNION ALL ".join(parts)


@register("profile", _profile_sql())
def q_profile(spark, sf):
    """Long-form profile of events.value / user_id per event_type."""
    p = column_profile(t(spark, sf, "events"), ["value", "user_id"], by=["event_type"])
    out = p.select("event_type", "column", "n", "mean", "std", "vmin", "vmax", "n_distinct", "zero_ratio",
                   "skewness", "kurtosis", *[F.col("quantiles")[i].alias(f"q{q}")
                                             for i, q in enumerate((25, 50, 75, 95))])
    out = rounded(out, ["mean", "std", "zero_ratio", "q25", "q50", "q75", "q95"])
    return rounded(out, ["skewness", "kurtosis"], 6)


@register("null_counts", """
SELECT "column", position, n_rows, n_null, n_null / n_rows AS null_ratio FROM (
  SELECT 'doc_id' AS "column", 0 AS position, count(*) AS n_rows, count(*) - count(doc_id) AS n_null FROM {s}
  UNION ALL SELECT 'lang', 1, count(*), count(*) - count(lang) FROM {s}
  UNION ALL SELECT 'source', 2, count(*), count(*) - count(source) FROM {s}
  UNION ALL SELECT 'n_chars', 3, count(*), count(*) - count(n_chars) FROM {s}
  UNION ALL SELECT 'quality', 4, count(*), count(*) - count(quality) FROM {s}
  UNION ALL SELECT 'toxic', 5, count(*), count(*) - count(toxic) FROM {s})""".replace("{s}", DOC_LABELS_SQL))
def q_null_counts(spark, sf):
    return null_counts(_doc_labels(spark, sf))


@register("validate", f"""
SELECT count(*) AS n_rows, 6 AS n_columns,
  (SELECT sum(x) FROM (SELECT count(*) - count(quality) AS x FROM {DOC_LABELS_SQL}
                       UNION ALL SELECT count(*) - count(toxic) FROM {DOC_LABELS_SQL})) AS n_null_cells,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT lang, source, n_chars, quality, toxic FROM {DOC_LABELS_SQL})) AS duplicates_count
FROM {DOC_LABELS_SQL}""")
def q_validate(spark, sf):
    """A1: shape, missing cells, duplicates ignoring identifier columns (doc_id is one)."""
    return validate_dataset(_doc_labels(spark, sf))


@register("duplicates", """
SELECT count(*) - count(DISTINCT (l_quantity, l_discount, l_tax)) AS duplicates_count,
       count(DISTINCT (l_quantity, l_discount, l_tax)) AS distinct_rows FROM lineitem""")
def q_duplicates(spark, sf):
    return duplicate_count(t(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])


@register("duplicate_rows", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM (
  SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS rn
  FROM orders) WHERE rn > 1""")
def q_duplicate_rows(spark, sf):
    """Later occurrences of a repeated (customer, status, priority) combination."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return duplicate_rows(o, ["o_custkey", "o_orderstatus", "o_orderpriority"], ["o_orderkey"])


def _types_sql() -> str:
    # orders: o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    num = ("SELECT '{c}' AS \"column\", {i} AS position, count({c}) AS n, count(DISTINCT {c}) AS n_distinct, "
           "CASE WHEN count({c}) = 0 THEN 'unknown' "
           "WHEN count(DISTINCT {c}) = 2 AND min({c}) = 0 AND max({c}) = 1 THEN 'boolean' "
           "WHEN bool_and({c} % 1 = 0) THEN 'numeric_discrete' ELSE 'numeric_continuous' END AS role, "
           "(count({c}) >= 4 AND bool_and({c} % 1 = 0) AND count({c}) = count(DISTINCT {c}) "
           "AND max({c}) - min({c}) = count({c}) - 1) AS is_identifier FROM orders")
    txt = ("SELECT '{c}', {i}, count({c}), count(DISTINCT {c}), "
           "CASE WHEN count({c}) = 0 THEN 'unknown' "
           "WHEN count(DISTINCT {c}) * 1.0 / count({c}) > 0.9 AND count({c}) > 3 THEN 'identifier' "
           "WHEN count(DISTINCT {c}) * 1.0 / count({c}) <= 0.5 THEN 'categorical' ELSE 'text_free' END, "
           "count(DISTINCT {c}) * 1.0 / count({c}) > 0.9 AND count({c}) > 3 FROM orders")
    parts = [num.format(c="o_orderkey", i=0), num.format(c="o_custkey", i=1),
             txt.format(c="o_orderstatus", i=2), num.format(c="o_totalprice", i=3),
             "SELECT 'o_orderdate', 4, count(o_orderdate), count(DISTINCT o_orderdate), 'datetime', false FROM orders",
             txt.format(c="o_orderpriority", i=5)]
    return " UNION ALL ".join(parts)


@register("column_types", _types_sql())
def q_column_types(spark, sf):
    """P3/P4 roles of every orders column (o_orderkey is a sequential identifier)."""
    return column_types(t(spark, sf, "orders")).drop("dtype")


@register("identifiers", """
SELECT 'c_custkey' AS "column", count(c_custkey) >= 4 AND count(c_custkey) = count(DISTINCT c_custkey)
   AND max(c_custkey) - min(c_custkey) = count(c_custkey) - 1 AS is_identifier FROM customer
UNION ALL SELECT 'c_name', count(DISTINCT c_name) * 1.0 / count(c_name) > 0.9 AND count(c_name) > 3 FROM customer
UNION ALL SELECT 'c_nationkey', count(c_nationkey) >= 4 AND count(c_nationkey) = count(DISTINCT c_nationkey)
   AND max(c_nationkey) - min(c_nationkey) = count(c_nationkey) - 1 FROM customer
UNION ALL SELECT 'c_acctbal', false
UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) * 1.0 / count(c_mktsegment) > 0.9 FROM customer""")
def q_identifiers(spark, sf):
    """P4 on customer: sequential keys and unique text both count as identifiers."""
    return column_types(t(spark, sf, "customer")).select("column", "is_identifier")


def _iqr_sql(by: bool) -> str:
    g = "event_type, " if by else ""
    part = "PARTITION BY event_type" if by else ""
    grp = "GROUP BY event_type" if by else ""
    return f"""
WITH b AS (
  SELECT {g}'value' AS "column", count(*) AS n, count(value) AS n_valid,
         quantile_cont(value::DOUBLE, 0.25) AS q1, quantile_cont(value::DOUBLE, 0.75) AS q3
  FROM events {grp})
SELECT {g}"column", n, n_valid, {O.sig('q1')} AS q1, {O.sig('q3')} AS q3,
  {O.sig('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {O.sig('q3 + 1.5 * (q3 - q1)')} AS upper_bound,
  (SELECT count(*) FROM events e WHERE {'e.event_type = b.event_type AND ' if by else ''}
     (e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1))) AS n_outliers,
  n >= 30 AS reliable
FROM b"""


IQR_COLS = ["column", "n", "n_valid", "q1", "q3", "lower_bound", "upper_bound", "n_outliers", "reliable"]


@register("iqr_bounds", _iqr_sql(False))
def q_iqr_bounds(spark, sf):
    b = iqr_bounds(t(spark, sf, "events"), ["value"])
    return rounded(b.select(*IQR_COLS), ["q1", "q3", "lower_bound", "upper_bound"])


@register("iqr_by_segment", _iqr_sql(True))
def q_iqr_by_segment(spark, sf):
    b = iqr_bounds(t(spark, sf, "events"), ["value"], by=["event_type"])
    return rounded(b.select("event_type", *IQR_COLS), ["q1", "q3", "lower_bound", "upper_bound"])


@register("iqr_outliers", """
WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
           FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value FROM events e JOIN b ON b.event_type = e.event_type
WHERE e.value < q1 - 1.5 * (q3 - q1) OR e.value > q3 + 1.5 * (q3 - q1)""")
def q_iqr_outliers(spark, sf):
    """The outlying events themselves, fences per event_type."""
    o = iqr_outliers(t(spark, sf, "events"), "value", by=["event_type"], key_cols=["event_id"])
    return o.select("event_id", "event_type", "value")


@register("sequential_in_order", """
SELECT "column", order_by, n, (n >= 4 AND min(d) = max(d) AND abs(min(d)) = 1) AS is_sequential FROM (
  SELECT 'o_orderkey' AS "column", 'o_orderkey' AS order_by, count(*) OVER () AS n,
         o_orderkey - lag(o_orderkey) OVER (ORDER BY o_orderkey) AS d FROM orders
  UNION ALL
  SELECT 'o_orderkey', 'o_totalprice', count(*) OVER (),
         o_orderkey - lag(o_orderkey) OVER (ORDER BY o_totalprice) FROM orders
  UNION ALL
  SELECT 'o_custkey', 'o_orderkey', count(*) OVER (),
         o_custkey - lag(o_custkey) OVER (ORDER BY o_orderkey) FROM orders)
GROUP BY "column", order_by, n""")
def q_sequential_in_order(spark, sf):
    """W1/P4 in row order: the order key is sequential in its own order, not in price order."""
    from ..operators.schema import sequential_in_order
    o = t(spark, sf, "orders")
    a = sequential_in_order(o, "o_orderkey", "o_orderkey")
    b = sequential_in_order(o, "o_orderkey", "o_totalprice")
    c = sequential_in_order(o, "o_custkey", "o_orderkey")
    return a.unionByName(b).unionByName(c)
