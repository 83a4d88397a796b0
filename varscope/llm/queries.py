"""Thin queries of the operators over the whole given tables: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embedding_index, html_mincut, mixing, ngram_join, oracles, packing
from . import quality_rules, ranked_search, substring_dedup, suffix_dedup, token_files, toxicity, whitening
from .common import table
from .tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


@register("op1_html_mincut")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_mincut.extract_pages(table(spark, sf_dir, "pages"))


@register("op2_mixing", oracles.MIXING)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@register("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), "space")
    return token_files.read_token_files(spark, files, ids=False)


@register("op4_quality_rules", oracles.QUALITY)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op5_substring_dedup", oracles.SUBSTRINGS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(table(spark, sf_dir, "documents"), keep_text=False)


@register("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"), keep_bytes=False)


@register("op7_ngram_join", oracles.NGRAMS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.similarity_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


@register("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False)


@register("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@register("op10_embedding_index", oracles.EMBEDDINGS)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_index.near_duplicates(table(spark, sf_dir, "embeddings"))


@register("op11_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    ids = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op12_ranked_search", oracles.RANKED)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op13_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
