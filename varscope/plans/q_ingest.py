"""Queries: S1-S8 (CSV ingest of a locale-formatted export written from a given table)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.profile import describe
from ..session import ensure_checkpoint_dir
from ..sources.csv_ingest import import_file
from . import oracle_sql as O
from .queries import register, rounded, t


def _export_path(spark) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/ingest-{uuid.uuid4().hex}/customer.csv"


def _export(spark, sf) -> str:
    """Write customer as a French-style export: ';' separator, decimal comma,
    'N/D' for the balance of every seventh customer."""
    path = _export_path(spark)
    c = t(spark, sf, "customer")
    bal = F.when(F.col("c_custkey") % 7 == 0, F.lit("N/D")).otherwise(
        F.replace(F.format_number("c_acctbal", 2).cast("string"), F.lit(","), F.lit("")))
    out = c.select("c_custkey", "c_name", "c_nationkey",
                   F.replace(bal, F.lit("."), F.lit(",")).alias("c_acctbal"), "c_mktsegment")
    out.write.option("header", True).option("sep", ";").mode("overwrite").csv(path)
    return path


@register("csv_ingest", f"""
SELECT "column", n, {O.sig('mean')} AS mean, {O.sig('std')} AS std, min, max, {O.sig('median')} AS median FROM (
  SELECT 'c_custkey' AS "column", count(c_custkey) AS n, avg(c_custkey::DOUBLE) AS mean, stddev_samp(c_custkey::DOUBLE) AS std,
         min(c_custkey)::DOUBLE AS min, max(c_custkey)::DOUBLE AS max, quantile_cont(c_custkey::DOUBLE, 0.5) AS median FROM customer
  UNION ALL
  SELECT 'c_nationkey', count(c_nationkey), avg(c_nationkey::DOUBLE), stddev_samp(c_nationkey::DOUBLE),
         min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE, quantile_cont(c_nationkey::DOUBLE, 0.5) FROM customer
  UNION ALL
  SELECT 'c_acctbal', count(b), avg(b), stddev_samp(b), min(b), max(b), quantile_cont(b, 0.5)
  FROM (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS b FROM customer))""")
def q_csv_ingest(spark, sf):
    """The export is re-read with detected encoding and ';', 'N/D' becomes NULL,
    decimal commas become doubles; then described (A3)."""
    df = import_file(spark, _export(spark, sf))
    d = describe(df, ["c_custkey", "c_nationkey", "c_acctbal"])
    return rounded(d.select("column", "n", "mean", "std", "min", "max", "median"), ["mean", "std", "median"])


@register("csv_mixed_folder", """
SELECT c_custkey, 'Société ' || c_name || '; "' || c_mktsegment || '", ' || c_nationkey AS label, round(c_acctbal, 2) AS balance FROM customer""")
def q_csv_mixed_folder(spark, sf):
    """S2-S4 by file: one folder with UTF-8 files (';', decimal comma) and files of one byte a character (',', decimal
    point); quoted labels hold both delimiters and quotes."""
    path = _export_path(spark)
    c = t(spark, sf, "customer")
    label = F.concat(F.lit("Société "), "c_name", F.lit('; "'), "c_mktsegment", F.lit('", '), F.col("c_nationkey").cast("string"))
    point = F.replace(F.format_number("c_acctbal", 2), F.lit(","), F.lit(""))
    for rest, sep, charset, number in ((0, ";", "UTF-8", F.replace(point, F.lit("."), F.lit(","))), (1, ",", "ISO-8859-1", point)):
        part = c.where(F.col("c_custkey") % 2 == rest).select("c_custkey", label.alias("label"), number.alias("balance"))
        part.write.option("header", True).option("sep", sep).option("encoding", charset).option("escape", '"').mode("append").csv(path)
    return import_file(spark, path)


def _types_sql() -> str:
    def row(c, pos, dtype, expr, role):
        seq = f"count(DISTINCT {expr}) = count({expr}) AND count({expr}) >= 4 AND max({expr}) - min({expr}) = count({expr}) - 1"
        ident = seq if dtype == "bigint" else f"({role}) = 'identifier'"
        return (f"SELECT '{c}' AS \"column\", {pos} AS position, '{dtype}' AS dtype, count({expr}) AS n, "
                f"count(DISTINCT {expr}) AS n_distinct, {role} AS role, {ident} AS is_identifier FROM x")
    text = ("CASE WHEN count(DISTINCT {0}) > 0.9 * count({0}) AND count({0}) > 3 THEN 'identifier' "
            "WHEN count(DISTINCT {0}) <= 0.5 * count({0}) THEN 'categorical' ELSE 'text_free' END")
    parts = [row("c_custkey", 0, "bigint", "c_custkey", "'numeric_discrete'"), row("c_name", 1, "string", "c_name", text.format("c_name")),
             row("c_nationkey", 2, "bigint", "c_nationkey", "'numeric_discrete'"),
             row("c_acctbal", 3, "double", "b", "CASE WHEN bool_and(b = round(b)) THEN 'numeric_discrete' ELSE 'numeric_continuous' END"),
             row("c_mktsegment", 4, "string", "c_mktsegment", text.format("c_mktsegment"))]
    return ("WITH x AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS b FROM customer) "
            + " UNION ALL ".join(parts))


@register("csv_types", _types_sql())
def q_csv_types(spark, sf):
    """Physical types and roles after ingest."""
    from ..operators.schema import column_types
    return column_types(import_file(spark, _export(spark, sf)))
