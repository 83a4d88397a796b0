"""S8 - writing report tables (Parquet/JSON), one JSON document per row, and one nested document per report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_list
from ..functions.joins import keyed_join

#: Sections of a report document: name, table of the report, and whether it is one object or a list of them.
#: Each table has a row per column, per rule or per scenario of a segment, none a row per input row.
SECTIONS = [("validation", "validation", True), ("profiling", "profile", False), ("distribution", "distribution", False),
            ("anomalies", "anomalies", False), ("top_correlations", "top_pairs", False), ("warnings_structured", "findings", False),
            ("exploitability", "score", True), ("simulation", "simulation", False), ("main_insight", "main_insight", True)]
#: Nulls are written; digits are those of the shortest text that reads back as the same double.
JSON_OPTIONS = {"ignoreNullFields": "false"}


def write_results(results: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One folder per result table under ``path``; executors write in parallel."""
    for name, df in results.items():
        df.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")


def to_json_rows(df: DataFrame) -> DataFrame:
    """``json`` column with every row serialised (to_dict-like view)."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def _plain(df: DataFrame, name: str) -> Column:
    """A column that can be ordered: a map becomes its sorted entries."""
    c = F.col(f"`{name}`")
    return (F.sort_array(F.map_entries(c)) if isinstance(df.schema[name].dataType, T.MapType) else c).alias(name)


def report_sections(report: dict[str, DataFrame], by: str | Sequence[str] | None = None) -> DataFrame:
    """``by..., report``: the tables of a report as one nested row, or one a segment.

    ``report`` comes from ``generate_report`` or ``segment_reports``, whose tables begin with the segment's columns:
    give those as ``by``. Fields: ``dataset_summary`` (n_rows, n_columns, numeric_columns), the :data:`SECTIONS` and
    ``warnings`` (the codes). Lists are sorted; a table without rows is an empty list or a null object, a table that the
    report doesn't have is left out. Segments come from ``validation``, which has a row for each.
    """
    by = as_list(by)
    types = report["column_types"]
    numeric = F.col("role").startswith("numeric")
    summary = types.groupBy(*by).agg(F.count(F.lit(1)).alias("n_columns"),
                                     F.array_sort(F.collect_list(F.when(numeric, F.col("column")))).alias("numeric_columns"))
    out = keyed_join(report["validation"].select(*by, "n_rows"), summary, by, "left")
    fields = [F.struct("n_rows", "n_columns", "numeric_columns").alias("dataset_summary")]
    for section, name, one in SECTIONS:
        if name not in report:
            continue
        df = report[name]
        row = F.struct(*[_plain(df, c) for c in df.columns if c not in by])
        rows = df.groupBy(*by).agg(F.sort_array(F.collect_list(row)).alias(f"_{section}"))
        out = keyed_join(out, rows, by, "left")
        each = F.col(f"_{section}")
        fields.append((F.get(each, F.lit(0)) if one else F.coalesce(each, F.array())).alias(section))
    if "findings" in report:
        fields.append(F.coalesce(F.array_distinct(F.col("_warnings_structured.code")), F.array()).alias("warnings"))
    return out.select(*by, F.struct(*fields).alias("report"))


def report_documents(report: dict[str, DataFrame], by: str | Sequence[str] | None = None) -> DataFrame:
    """``by..., document``: :func:`report_sections` as JSON, one document a report. ``from_json`` with the sections'
    schema (:func:`document_schema`) reads it back equal."""
    sections = report_sections(report, by)
    return sections.select(*as_list(by), F.to_json("report", JSON_OPTIONS).alias("document"))


def document_schema(report: dict[str, DataFrame], by: str | Sequence[str] | None = None) -> T.StructType:
    return report_sections(report, by).schema["report"].dataType


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The documents as JSON lines; a segment's columns, if any, are in front as a field each."""
    by = [c for c in documents.columns if c != "document"]
    # the document is JSON already: it takes its place in the line as it is
    head = F.to_json(F.struct(*by), JSON_OPTIONS) if by else F.lit("{}")
    line = F.concat(F.expr("left(h, length(h) - 1)"), F.when(F.col("h") == "{}", F.lit("")).otherwise(F.lit(",")), F.lit('"report":'), "document", F.lit("}"))
    documents.select("document", head.alias("h")).select(line.alias("value")).write.mode(mode).text(path)
