"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteframe.llm import (backoff, bitsliced, bursttrie, chat, decontaminate, hnsw, langid, mainhtml, mixture, quality, simhash, sqltwins, urlrules,
                           warc)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality.judge(_table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict of the URL rules for every page."""
    return urlrules.judge(_table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = _table(spark, folder, "pages")
    return mainhtml.extract(pages, [F.col("page_id"), F.col("url")]).withColumn("n_chars", F.length("text").cast("long"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What the salvage reader finds of every page in archives that were written of all pages."""
    return warc.round_trip(_table(spark, folder, "pages"))


def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixture.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.components(_table(spark, folder, "documents")).select(
        "doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that says control strings, as read back."""
    rows = _table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(chat.text_parts(rows.unionByName(extra))))


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(_table(spark, folder, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark hits of every document."""
    found = decontaminate.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document."""
    return backoff.score_documents(_table(spark, folder, "documents"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return bursttrie.trie(bursttrie.rebuilt(bursttrie.sequences(_table(spark, folder, "conversations"))))


def op12_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return hnsw.nearest(_table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return bitsliced.rank(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_quality_rules, op2_url_filter, op3_main_text, op4_warc, op5_mix, op6_simhash, op7_chat, op8_language, op9_decontamination,
    op10_lm_score, op11_prefix_trie, op12_neighbours, op13_lexical_search, pipeline)}

ORACLES: dict[str, str] = {
    "op1_quality_rules": sqltwins.QUALITY, "op2_url_filter": sqltwins.url_rules(), "op4_warc": sqltwins.WARC, "op5_mix": sqltwins.MIX,
    "op7_chat": sqltwins.CHAT, "op9_decontamination": sqltwins.DECONTAMINATION,
    "op11_prefix_trie": sqltwins.PREFIX_TRIE, "op13_lexical_search": sqltwins.LEXICAL_SEARCH}
