"""F1-F4 - coded findings, the 0-100 usability score and the top finding.

Every rule is a filter/projection over an operator result and yields rows of
one schema; the report unions them. No text matching: codes come straight
from numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FINDING_SCHEMA = ("code string, severity string, category string, columns array<string>, "
                  "metric double, priority int")

# Priority of a finding when choosing the single main insight (F4), lower wins.
PRIORITY = {
    "SIMULATION_NON_ACTIONABLE_R2": 1, "SIMULATION_PALIERS": 1,
    "CONFOUNDER": 2,
    "SUBGROUP_DOMINANT_STRONG": 3,
    "NONLINEAR_QUAD": 4, "NONLINEAR_STEP": 4,
    "ASYMMETRY": 5, "DISTRIBUTION_COUNT": 5, "DISTRIBUTION_HEAVY": 5, "DISTRIBUTION_ZERO": 5, "ASYMMETRY_SUBGROUP": 5,
    "SAISONNALITE": 6, "SEASONAL_RISK": 6,
    "TOP_PAIR": 7,
}
DEFAULT_PRIORITY = 8
# Thresholds of the rules.
SMALL_SAMPLE_THRESHOLD = 30
WIDE_TABLE_COLUMNS = 50
DISTRIBUTION_SUMMARY_COLUMNS = 4
LOW_R_SQUARED_THRESHOLD = 0.3


def finding(df: DataFrame, code: str | Column, severity: str | Column, category: str,
            columns: Column, metric: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    code_c = F.lit(code) if isinstance(code, str) else code
    sev_c = F.lit(severity) if isinstance(severity, str) else severity
    prio = F.coalesce(F.element_at(F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))]),
                                   code_c), F.lit(DEFAULT_PRIORITY))
    return df.select(*by, code_c.alias("code"), sev_c.alias("severity"), F.lit(category).alias("category"),
                     columns.cast("array<string>").alias("columns"),
                     (metric if metric is not None else F.lit(None)).cast("double").alias("metric"),
                     prio.cast("int").alias("priority"))


def empty_findings(spark: SparkSession, segment_schema: str = "") -> DataFrame:
    return spark.createDataFrame([], segment_schema + FINDING_SCHEMA)


def union_findings(spark: SparkSession, parts: Sequence[DataFrame], segment_schema: str = "") -> DataFrame:
    out = empty_findings(spark, segment_schema)
    for p in parts:
        out = out.unionByName(p)
    return out


def dedupe_codes(findings: DataFrame, unique_codes: Sequence[str] = ("MULTIPLE_TESTING", "WIDE_TABLE",
                                                                    "SMALL_SAMPLE", "NO_NUMERIC",
                                                                    "DISTRIBUTION_SUMMARY"),
                 by: Sequence[str] = ()) -> DataFrame:
    """One row a segment for codes that must appear once (first by priority, then metric)."""
    w = Window.partitionBy(*by, "code").orderBy("priority", F.col("metric").desc_nulls_last(), "columns")
    keep = F.col("code").isin(*unique_codes)
    return (findings.withColumn("_r", F.row_number().over(w))
            .where(~keep | (F.col("_r") == 1)).drop("_r"))


def score(n_rows: Column, n_findings: Column, n_anomaly_cols: Column,
          r_squared: Column, actionable: Column) -> tuple[Column, Column]:
    """F3 as column expressions: (score 0..100, level green/orange/red)."""
    s = F.lit(100)
    s = s - F.when(n_rows < 15, 50).when(n_rows < SMALL_SAMPLE_THRESHOLD, 25).otherwise(0)
    s = s - (F.when(n_findings <= 3, 0).when(n_findings <= 5, 10).when(n_findings <= 8, 25)
             .when(n_findings <= 12, 40).otherwise(55))
    s = s - n_anomaly_cols * 5
    s = s - (F.when(r_squared.isNull(), 0).when(r_squared < 0.01, 50).when(r_squared < 0.05, 40)
             .when(r_squared < 0.1, 30).when(r_squared < LOW_R_SQUARED_THRESHOLD, 15).otherwise(0))
    s = F.when((actionable == F.lit(False)) & (s >= 70), F.lit(69)).otherwise(s)
    s = F.greatest(F.lit(0), s)
    level = F.when(s >= 70, F.lit("green")).when(s >= 40, F.lit("orange")).otherwise(F.lit("red"))
    return s.cast("int"), level


def main_insight(findings: DataFrame, scenario_cols: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """the single most important finding of a segment (scenario columns first within a priority)."""
    touches = (F.arrays_overlap(F.col("columns"), F.array(*[F.lit(c) for c in scenario_cols]))
               if scenario_cols else F.lit(False))
    w = Window.partitionBy(*by).orderBy("priority", touches.desc(), F.col("metric").desc_nulls_last(), "code", "columns")
    return findings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
