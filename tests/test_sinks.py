import json
import os

from pyspark.sql import functions as F

from conftest import frame
from varscope.sources.sinks import document_schema, report_documents, to_json_rows, write_documents, write_results


def test_write_results_and_json_rows(spark, tmp_path):
    a = frame(spark, {"k": ["x", "y"], "v": [1.5, 2.5]})
    out = os.path.join(str(tmp_path), "report")
    write_results({"a": a}, out)
    back = spark.read.parquet(os.path.join(out, "a"))
    assert sorted(tuple(r) for r in back.collect()) == [("x", 1.5), ("y", 2.5)]
    rows = [json.loads(r["json"]) for r in to_json_rows(a).collect()]
    assert {"k": "x", "v": 1.5} in rows


def small_report(spark):
    types = spark.createDataFrame([("a", "v", "numeric_discrete"), ("a", "t", "text_free"), ("b", "v", "identifier")], "g string, column string, role string")
    validation = spark.createDataFrame([("a", 5, {"v": 1}), ("b", 2, None), (None, 1, {})], "g string, n_rows long, nulls map<string,int>")
    profile = spark.createDataFrame([("a", "v", 0.1 + 0.2, [1e-300, None]), ("b", "v", None, [])], "g string, column string, mean double, q array<double>")
    findings = spark.createDataFrame([("a", "X", ["v", "é\"\n"]), ("a", "W", []), ("a", "X", None)], "g string, code string, columns array<string>")
    return {"column_types": types, "validation": validation, "profile": profile, "findings": findings}


def test_documents_read_back(spark, tmp_path):
    report = small_report(spark)
    docs = report_documents(report, "g")
    schema = document_schema(report, "g")
    rows = {r["g"]: r["d"] for r in docs.select("g", F.from_json("document", schema).alias("d")).collect()}
    assert set(rows) == {"a", "b", None}                                      # null is a segment too
    a = rows["a"]
    assert a["dataset_summary"].asDict() == {"n_rows": 5, "n_columns": 2, "numeric_columns": ["v"]}
    assert [(r["key"], r["value"]) for r in a["validation"]["nulls"]] == [("v", 1)]
    assert a["profiling"][0].asDict() == {"column": "v", "mean": 0.1 + 0.2, "q": [1e-300, None]}
    assert [(f["code"], f["columns"]) for f in a["warnings_structured"]] == [("W", []), ("X", None), ("X", ["v", "é\"\n"])]
    assert a["warnings"] == ["W", "X"]
    assert rows["b"]["profiling"][0]["mean"] is None and rows["b"]["warnings"] == [] and rows[None]["profiling"] == []
    assert "simulation" not in schema.fieldNames() and "simulation" not in a.asDict()
    path = os.path.join(str(tmp_path), "docs")
    write_documents(docs, path)
    lines = [json.loads(r["value"]) for r in spark.read.text(path).collect()]
    assert {d["g"]: d["report"]["dataset_summary"]["n_rows"] for d in lines} == {"a": 5, "b": 2, None: 1}


def test_one_document_without_segments(spark, tmp_path):
    report = {k: v.where("g = 'a'").drop("g") for k, v in small_report(spark).items()}
    docs = report_documents(report)
    assert docs.columns == ["document"] and json.loads(docs.first()["document"])["warnings"] == ["W", "X"]
    path = os.path.join(str(tmp_path), "one")
    write_documents(docs, path)
    assert json.loads(spark.read.text(path).first()["value"])["report"]["dataset_summary"]["n_rows"] == 5
