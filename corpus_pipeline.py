"""A corpus pipeline: language, quality, near-duplicates, benchmark leaks, then SentencePiece encoding.

Each stage works on all rows that its predecessor kept, written as Parquet. The models of the first two stages are
fitted on the rows of the stage's input that are outside their held-out folds. The result has one row for each document
that stays: doc_id, n_tokens, ids_sha256, decoded_sha256.

Columns of documents pass through unchanged up to the last stage; empty tables give empty tables (and with nothing to
learn from, no document has a language). Null and empty texts have no letter, and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesserine.llm import decontaminate, language_id, near_dedup, quality, sentencepieces
from tesserine.llm.common import bounded_batches, crc_mod, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or like no learned language, go."""
    bounded_batches(spark)
    profiles = language_id.learn(docs, crc_mod("doc_id", 4) != 2)
    return language_id.accepted(docs, profiles)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below 0.7 go."""
    bounded_batches(spark)
    machine = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_mod("doc_id", 4) != 2)
    return quality.accepted(docs, machine)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates, the document with the smallest id stays."""
    return near_dedup.deduplicated(docs, threshold=0.8)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a fifth of its words edited, go."""
    bounded_batches(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and decoded texts of the documents that stay."""
    return sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("quality", good), ("near-duplicates", distinct), ("decontamination", clean), ("encoding", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
