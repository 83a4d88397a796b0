"""The pipeline's stages and the registered queries."""

from __future__ import annotations

import corpus_pipeline
import __spark_entry__ as entry
from tests.llm.data import documents, frame
from varscope.llm import ngram_join, quality_rules
from varscope.llm.queries import REGISTRY


def test_registered():
    names = set(entry.queries())
    assert set(REGISTRY) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mix", "pack"]


def test_stages(spark, tmp_path):
    docs = frame(spark, clash=False)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = docs
        if name != "packing":
            assert docs.columns == columns
    kept = rows["quality rules"]
    want = [r for r in documents() if quality_rules.judge((r[1] or "").encode())[0][6]]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    single = rows["n-gram Jaccard join"]
    label = ngram_join.similarity_components(kept).select("component_id").distinct().count()
    assert single.count() == label < kept.count()
    assert rows["substring dedup"].count() == label
    assert all(r["n_chars"] == len(r["text"]) for r in rows["substring dedup"].collect())
    mixed = rows["mixing"].groupBy("doc_id").count()
    assert mixed.agg({"count": "max"}).first()[0] <= 3
    pieces = rows["packing"]
    assert pieces.filter("piece = 0").count() == rows["mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()


def test_empty(spark, tmp_path):
    frame(spark, [], clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
