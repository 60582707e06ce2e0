"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhlens.llm import (
    byte_bpe, conversation_repair, decontaminate, fingerprint, jaccard_join, language_id, line_dedup, lm_score, oracle,
    oracle_conversations, pii, prefix_trie, token_counts, token_files, warc)
from kwhlens.session import Scratch

SQL = oracle.SQL | oracle_conversations.SQL

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = lm_score.target_ids(_table(spark, sf_dir, "labels"))
    return lm_score.cross_entropy_difference(_table(spark, sf_dir, "documents"), targets).withColumn(
        "score", F.round("score", 9))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "warc").path
    names = warc.write_pages(_table(spark, sf_dir, "pages"), folder)
    return warc.page_summary(warc.assemble(warc.read_records(spark, folder, names)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark, "tokens").path
    manifest = token_files.write_tokens(_table(spark, sf_dir, "documents"), folder, WORD_BPE, end_id=2)
    return token_files.read_tokens(spark, folder, manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def op5_site_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_site_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "n_lines", "n_dropped", "text")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_comparison(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprint.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs.select("doc_id", "text"), language_id.train(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = byte_bpe.encode(_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN, decoded=True)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", *[F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
                    for kind in pii.KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(_table(spark, sf_dir, "conversations"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts.token_counts(_table(spark, sf_dir, "documents"), WORD_BPE)
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_benchmark_decontamination, op2_lm_score, op3_warc, op4_token_files, op5_site_line_dedup, op6_fingerprint,
        op7_ngram_jaccard_join, op8_language_id, op9_byte_bpe, op10_personal_data,
        op11_prefix_trie, op12_conversation_repair, op13_token_counts)
}
