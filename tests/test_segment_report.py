"""The reports of all segments, made in the same jobs, are those of each segment alone."""

import numpy as np
from pyspark.sql import functions as F

from varscope.operators.derived import derived_pairs
from varscope.operators.quality import duplicate_count, null_counts, validate_dataset
from varscope.operators.schema import column_types, temporal_columns, temporal_flags
from varscope.plans.report import generate_report, segment_reports
from varscope.sources.sinks import document_schema, report_documents


def table(spark):
    rng = np.random.default_rng(3)
    n = 300
    seg = rng.choice(["a", "b"], n, p=[0.6, 0.4])
    x, q, p = rng.uniform(10, 20, n), rng.integers(1, 10, n).astype(float), rng.uniform(1, 10, n)
    region = rng.choice(["n", "s", "e"], n)
    effect = {"n": 0.0, "s": 40.0, "e": 80.0}
    y = [(effect[r] if s == "a" else (v - 15) ** 2) + e for r, s, v, e in zip(region, seg, x, rng.normal(size=n))]
    # two values in b only; derived in a only; an identifier in b only
    flag = [float(v > 15) if s == "b" else float(i % 4) for i, (s, v) in enumerate(zip(seg, x))]
    total = [u * v if s == "a" else w for s, u, v, w in zip(seg, p, q, x[::-1])]
    code = [f"k{i}" if s == "b" else "same" for i, s in enumerate(seg)]
    rows = [(i, str(s), str(r), c, float(a), float(b), float(d), float(t), float(u), float(f))
            for i, (s, r, c, a, b, d, t, u, f) in enumerate(zip(seg, region, code, x, p, q, total, y, flag))]
    rows += [(n, None, "n", "z", *[1.0] * 6), (n + 1, "tiny", "n", "z", *[1.0] * 6)]
    return spark.createDataFrame(rows, "id long, seg string, region string, code string, x double, price double, qty double, "
                                       "total double, y double, flag double").repartition(4)


def plain(rows, cols):
    return sorted(str([float(f"{r[c]:.6g}") if isinstance(r[c], float) else r[c] for c in cols]) for r in rows)


def documents_hold_the_tables(report, found, by):
    """The nested documents, read back from JSON, are the report's tables."""
    docs = report_documents(report, by)
    back = {r["segment"]: r["d"] for r in docs.select("segment", F.from_json("document", document_schema(report, by)).alias("d")).collect()}
    assert set(back) == {r["segment"] for r in found["validation"]}
    for section, name, one in (("validation", "validation", True), ("warnings_structured", "findings", False), ("exploitability", "score", True),
                               ("main_insight", "main_insight", True)):
        cols = [c for c in found[name][0].__fields__ if c not in by]
        for segment, d in back.items():
            want = sorted(str([r[c] for c in cols]) for r in found[name] if r["segment"] == segment)
            got = d[section] if not one else [d[section]] if d[section] else []
            assert sorted(str([r[c] for c in cols]) for r in got) == want
    for segment, d in back.items():
        types = [r for r in found["column_types"] if r["segment"] == segment]
        assert d["dataset_summary"]["n_columns"] == len(types)
        assert d["dataset_summary"]["numeric_columns"] == sorted(r["column"] for r in types if r["role"].startswith("numeric"))
        assert set(d["warnings"]) == {r["code"] for r in found["findings"] if r["segment"] == segment}


def test_segments_are_reported_as_if_alone(spark):
    df = table(spark).cache()
    options = {"target": "y", "feature": "x", "change_pct": 0.1, "key_cols": ["id"]}
    every = segment_reports(df, "seg", **options)
    found = {k: every[k].collect() for k in ("findings", "score", "main_insight", "validation", "column_types")}
    assert {r["segment"] for r in found["score"]} == {"a", "b"}               # too small a segment and null keys have none
    documents_hold_the_tables(every, found, ["segment", "by_seg"])
    codes = {s: {r["code"] for r in found["findings"] if r["by_seg"] == s} for s in "ab"}
    assert "DERIVED" in codes["a"] and "DERIVED" not in codes["b"] and "SUBGROUP_DOMINANT_STRONG" in codes["a"]
    assert "SCENARIO_NONLINEAR" in codes["b"] and "SCENARIO_NONLINEAR" not in codes["a"]
    alone = generate_report(df.where(F.col("seg") == "b"), **options)
    for k, rows in found.items():
        assert plain([r for r in rows if r["segment"] == "b"], alone[k].columns) == plain(alone[k].collect(), alone[k].columns), k


def test_operators_by_segment(spark):
    df = table(spark).where("seg in ('a', 'b')").cache()
    types = column_types(df, by=["seg"])
    ids = {(r["seg"], r["column"]) for r in types.where("is_identifier").collect()}
    assert ("b", "code") in ids and ("a", "code") not in ids
    by_seg = {"types": types, "nulls": null_counts(df, by=["seg"]), "dups": duplicate_count(df, ["region", "qty"], by=["seg"]),
              "valid": validate_dataset(df, by=["seg"]), "derived": derived_pairs(df, ["x", "price", "qty", "total"], by=["seg"])}
    by_seg = {k: v.collect() for k, v in by_seg.items()}
    for s in "ab":
        one = df.where(F.col("seg") == s).drop("seg")
        alone = {"types": column_types(one), "nulls": null_counts(one), "dups": duplicate_count(one, ["region", "qty"]),
                 "valid": validate_dataset(one), "derived": derived_pairs(one, ["x", "price", "qty", "total"])}
        for k, v in alone.items():
            assert plain([r for r in by_seg[k] if r["seg"] == s], v.columns) == plain(v.collect(), v.columns), (k, s)


def test_temporal_by_segment(spark):
    df = spark.createDataFrame([("a", i % 5, i, "x") for i in range(60)] + [("b", i, i, "x") for i in range(60)],
                               "seg string, week int, year_rank int, month_name string")
    flags = temporal_flags(df, column_types(df, by=["seg"]), ["seg"]).collect()
    assert {tuple(r) for r in flags} == {("a", "week"), ("a", "month_name"), ("b", "month_name")}
    assert set(temporal_columns(df.where("seg = 'a'"))) == {"week", "month_name"}
