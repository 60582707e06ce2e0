"""Corpus pipeline: from ``documents`` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's rows as Parquet to the shared folder and
reads them again.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kwhlens.llm import byte_bpe, decontaminate, jaccard_join, language_id, line_dedup
from kwhlens.session import Scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that language identification rejects: no letter, or like no learned language."""
    return language_id.keep_known(docs, language_id.train(docs))


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that are boilerplate on their source; every document stays, n_chars follows its text."""
    return line_dedup.drop_site_lines(docs).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group linked by a 5-gram similarity of 0.8."""
    return jaccard_join.one_of_each_group(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) per document: its token ids, and the digest of the bytes they decode to."""
    tokens = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN, decoded=True)
    return tokens.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", site_lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_passages),
    ("byte_bpe", token_ids),
]

#: SQL can't express the language filters and the BPE; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            scratch.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
