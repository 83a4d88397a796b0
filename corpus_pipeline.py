"""A corpus pipeline over ``documents``: each stage is written as Parquet and read again.

Stages: quality rules, n-gram Jaccard join, substring dedup, mixing sources to target weights,
best-fit packing. All but the last return the columns of ``documents``; the last returns a row per
packed piece. An empty table passes through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.llm import mixing, ngram_join, packing, quality_rules, substring_dedup
from varscope.llm.common import shared_path, table
from varscope.llm.tokens import tokenizer_path

#: The stages end in token ids and packed sequences, which SQL can't express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the others stay as they are."""
    return quality_rules.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five words, similarity 0.8 or more."""
    return ngram_join.distinct_documents(docs, n=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that a document with a smaller id holds are cut from the text."""
    out = substring_dedup.deduplicated_documents(docs)
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return out.withColumn("n_chars", F.length("text").cast(kind)) if kind else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the sources' target weights takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece with its ids, sequence and offset."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
