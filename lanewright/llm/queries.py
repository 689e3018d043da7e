"""The operators applied to their whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chunk_encoding, conversation_repair, filter_audit, fingerprints, near_dedup, packing, quality_classifier, quality_rules, records, substring_dedup, token_counts, url_filters
from .common import read_table
from .mixing import mix_documents
from .tokens import tokenizer_path


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.score_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(read_table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(read_table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(read_table(spark, sf_dir, "documents"))


def op7_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.encode_and_read_back(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damage_and_repair(read_table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_encoding.digests_of_round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_fingerprints": op5_fingerprints,
    "op6_near_dedup": op6_near_dedup,
    "op7_binary_records": op7_binary_records,
    "op10_packing": op10_packing,
    "op8_source_mix": op8_source_mix,
    "op9_quality_rules": op9_quality_rules,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_filter_audit": op12_filter_audit,
    "op13_bpe_round_trip": op13_bpe_round_trip,
}

ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE_SQL,
    "op6_near_dedup": near_dedup.ORACLE_SQL,
    "op2_url_filter": url_filters.oracle_sql(),
    "op9_quality_rules": quality_rules.oracle_sql(),
    "op11_conversation_repair": conversation_repair.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
