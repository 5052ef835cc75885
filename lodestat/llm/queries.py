"""Registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestat.llm import arc, decontam, langid, line_crf, packing, pii, prefix_trie, probminhash, quality_rules, suffix_tree, superkmer, turn_repair, url_filter
from lodestat.llm.common import read


def op1_minhash(spark: SparkSession, d: str) -> DataFrame:
    return probminhash.near_duplicates(read(spark, d, "documents"))


def op2_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, d, "pages"))


def op3_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"))


def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    return arc.convert(read(spark, d, "pages"))


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    out = decontam.decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return superkmer.digests(read(spark, d, "documents"))


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(read(spark, d, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op8_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return suffix_tree.score_held_out(read(spark, d, "documents"))


def op9_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels")
    out = quality_rules.quality_rules(read(spark, d, "documents"), quality_rules.trusted_rows(labels), rejected=quality_rules.rejected_rows(labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    return line_crf.quality(read(spark, d, "documents"), read(spark, d, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_turn_repair(spark: SparkSession, d: str) -> DataFrame:
    conversations = read(spark, d, "conversations")
    return turn_repair.repair(turn_repair.damage(conversations), conversations)


def op12_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    return prefix_trie.prefix_trie(*prefix_trie.rebuild(prefix_trie.turns(read(spark, d, "conversations"))))


def op13_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_data(read(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_url_filter, op3_packing, op4_warc, op5_decontamination, op6_substring_dedup, op7_language_id, op8_lm_scoring, op9_quality_rules, op10_quality_classifier, op11_turn_repair, op12_prefix_trie, op13_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": arc.ORACLE, "op5_decontamination": decontam.ORACLE, "op6_substring_dedup": superkmer.ORACLE, "op11_turn_repair": turn_repair.ORACLE, "op12_prefix_trie": prefix_trie.ORACLE}
