"""Queries: F1-F4 (full report on orders x customer with a what-if scenario).

The report's outputs are rule-driven tables; they are checked row-count only
(no SQL oracle), the operators underneath have their own oracles.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.derived import derived_relationships
from ..operators.quality import validate_dataset
from ..operators.schema import column_types
from ..sources.sinks import document_schema, report_documents
from . import oracle_sql as O
from .queries import register, rounded, t
from .report import generate_report, segment_reports


def _orders_customer(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return o.join(c, "o_custkey")


def _report(spark, sf):
    return generate_report(_orders_customer(spark, sf), target="o_totalprice", feature="c_acctbal",
                           change_pct=0.10, key_cols=["o_orderkey"])


@register("findings")
def q_findings(spark, sf):
    """every coded finding of the orders x customer report."""
    f = _report(spark, sf)["findings"]
    return rounded(f.withColumn("columns", F.array_join("columns", ",")), ["metric"], 6)


@register("score")
def q_score(spark, sf):
    """usability score and level of the same report."""
    return _report(spark, sf)["score"]


@register("main_insight")
def q_main_insight(spark, sf):
    """the single top finding."""
    f = _report(spark, sf)["main_insight"]
    return rounded(f.withColumn("columns", F.array_join("columns", ",")), ["metric"], 6)


def _segment_reports(spark, sf):
    df = _orders_customer(spark, sf).drop("o_custkey")
    return segment_reports(df, "c_mktsegment", target="o_totalprice", feature="c_acctbal", change_pct=0.10, key_cols=["o_orderkey"])


@register("findings_by_segment")
def q_findings_by_segment(spark, sf):
    """Every coded finding of the report of each market segment, all segments in the same jobs."""
    f = _segment_reports(spark, sf)["findings"]
    return rounded(f.withColumn("columns", F.array_join("columns", ",")), ["metric"], 6)


@register("score_by_segment")
def q_score_by_segment(spark, sf):
    """Usability score and level of each market segment."""
    return _segment_reports(spark, sf)["score"]


TYPED = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate", "l_linestatus", "ref"]


def _typed(spark, sf):
    ref = F.when(F.col("l_returnflag") == "A", F.concat_ws("-", "l_orderkey", "l_linenumber")).otherwise(F.col("l_linestatus"))
    return t(spark, sf, "lineitem").withColumn("ref", ref).select("l_returnflag", *TYPED)


def _types_sql() -> str:
    parts = []
    for c in TYPED:
        if c == "l_shipdate":
            role, seq = "CASE WHEN n = 0 THEN 'unknown' ELSE 'datetime' END", "false"
            ends = "NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, false AS ints"
        elif c in ("l_linestatus", "ref"):
            role = ("CASE WHEN n = 0 THEN 'unknown' WHEN d > 0.9 * n AND n > 3 THEN 'identifier' "
                    "WHEN d <= 0.5 * n THEN 'categorical' ELSE 'text_free' END")
            seq, ends = "false", "NULL::DOUBLE AS mn, NULL::DOUBLE AS mx, false AS ints"
        else:
            role = ("CASE WHEN n = 0 THEN 'unknown' WHEN d = 2 AND mn = 0 AND mx = 1 THEN 'boolean' "
                    "WHEN ints THEN 'numeric_discrete' ELSE 'numeric_continuous' END")
            seq = "n >= 4 AND ints AND n = d AND mx - mn = n - 1"
            ends = f"min({c}::DOUBLE) AS mn, max({c}::DOUBLE) AS mx, bool_and({c}::DOUBLE = floor({c}::DOUBLE)) AS ints"
        parts.append(f"SELECT l_returnflag, '{c}' AS \"column\", n, d AS n_distinct, {role} AS role, "
                     f"({role}) = 'identifier' OR ({seq}) AS is_identifier FROM (SELECT l_returnflag, count({c}) AS n, "
                     f"count(DISTINCT {c}) AS d, {ends} FROM s GROUP BY l_returnflag)")
    src = ("SELECT *, CASE WHEN l_returnflag = 'A' THEN concat_ws('-', l_orderkey, l_linenumber) ELSE l_linestatus END AS ref FROM lineitem")
    return f"WITH s AS ({src}) " + " UNION ALL ".join(parts)


@register("types_by_segment", _types_sql())
def q_types_by_segment(spark, sf):
    """Roles and identifiers of the columns in each segment; ``ref`` is an identifier in one of them only."""
    return column_types(_typed(spark, sf), by=["l_returnflag"]).select("l_returnflag", "column", "n", "n_distinct", "role", "is_identifier")


@register("validate_by_segment", """
WITH s AS (SELECT l_returnflag, l_linenumber, l_linestatus, l_shipdate, CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN NULL ELSE l_tax END AS tax,
                  CASE WHEN l_returnflag = 'A' THEN concat_ws('-', l_orderkey, l_linenumber) ELSE l_linestatus END AS ref FROM lineitem),
g AS (SELECT l_returnflag, l_linenumber, l_linestatus, l_shipdate, tax, CASE WHEN l_returnflag = 'A' THEN NULL ELSE ref END AS ref, count(*) AS k
      FROM s GROUP BY ALL)
SELECT l_returnflag, sum(k)::BIGINT AS n_rows, 5 AS n_columns, sum(CASE WHEN tax IS NULL THEN k ELSE 0 END)::BIGINT AS n_null_cells,
       sum(k - 1)::BIGINT AS duplicates_count FROM g GROUP BY l_returnflag""")
def q_validate_by_segment(spark, sf):
    """Rows, missing cells and repeated rows of each segment; where ``ref`` is an identifier it isn't compared."""
    df = t(spark, sf, "lineitem").withColumn(
        "ref", F.when(F.col("l_returnflag") == "A", F.concat_ws("-", "l_orderkey", "l_linenumber")).otherwise(F.col("l_linestatus"))).withColumn(
        "tax", F.when(~((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)), F.col("l_tax")))
    return validate_dataset(df.select("l_returnflag", "l_linenumber", "l_linestatus", "l_shipdate", "tax", "ref"), by=["l_returnflag"])


#: a + b, a * b and a - b of two columns; in one segment the product is another column.
DERIVED = {"l_quantity": "l_quantity::DOUBLE", "l_tax": "l_tax::DOUBLE + 1", "added": "l_quantity + l_tax + 1",
           "times": "CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE l_quantity * (l_tax + 1) END", "less": "l_quantity - l_tax - 1"}


def _derived_sql() -> str:
    names = list(DERIVED)
    cols = ", ".join(f"({e})::DOUBLE AS {c}" for c, e in DERIVED.items())
    forms = {"product": "{a} * {b}", "sum": "{a} + {b}", "difference": "{a} - {b}", "reverse_difference": "{b} - {a}"}
    parts = []
    for c in names:
        rest = [x for x in names if x != c]
        for i, a in enumerate(rest):
            for b in rest[i + 1:]:
                for f, e in forms.items():
                    hit = f"abs({c} - ({e.format(a=a, b=b)})) / greatest(abs({c}), 1e-9) < 0.02"
                    parts.append(f"SELECT l_returnflag, '{c}' AS target, '{a}' AS col_a, '{b}' AS col_b, '{f}' AS form, "
                                 f"count(*) FILTER (WHERE {hit}) / count(*) AS share FROM s GROUP BY l_returnflag")
    return (f"WITH s AS (SELECT l_returnflag, {cols} FROM lineitem) SELECT l_returnflag, target, col_a, col_b, form, {O.sig('share')} AS match_share "
            f"FROM ({' UNION ALL '.join(parts)}) u WHERE share > 0.95")


@register("derived_by_segment", _derived_sql())
def q_derived_by_segment(spark, sf):
    """Derived columns of each segment."""
    df = t(spark, sf, "lineitem").select("l_returnflag", *[F.expr(e.replace("::DOUBLE", "")).cast("double").alias(c) for c, e in DERIVED.items()])
    return rounded(derived_relationships(df, list(DERIVED), ["l_returnflag"]), ["match_share"])


def _document_sql() -> str:
    def row(c):
        return (f"SELECT c_mktsegment AS segment, count(*) AS n_rows, '{c}' AS \"column\", count({c}) AS n, {O.sig(f'avg({c}::DOUBLE)')} AS mean, "
                f"min({c})::DOUBLE AS vmin, max({c})::DOUBLE AS vmax, {O.sig(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median FROM customer "
                "GROUP BY c_mktsegment HAVING count(*) >= 3")
    return " UNION ALL ".join(row(c) for c in ("c_acctbal", "c_nationkey"))


@register("report_documents", _document_sql())
def q_report_documents(spark, sf):
    """A nested JSON document per market segment, read back: the profiles it holds."""
    report = segment_reports(t(spark, sf, "customer").select("c_mktsegment", "c_acctbal", "c_nationkey"), "c_mktsegment")
    by = ["segment", "by_c_mktsegment"]
    docs = report_documents(report, by).select("segment", F.from_json("document", document_schema(report, by)).alias("d"))
    rows = docs.select("segment", F.col("d.dataset_summary.n_rows").alias("n_rows"), F.explode("d.profiling").alias("p"))
    return rounded(rows.select("segment", "n_rows", "p.column", "p.n", "p.mean", "p.vmin", "p.vmax", F.col("p.quantiles")[1].alias("median")),
                   ["mean", "median"])
