"""The registered queries of the training-data operators, and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import token_shards

    manifest = token_shards.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_shards.read_shards(manifest)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import lm_scoring

    return lm_scoring.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import topk_search

    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import decontaminate

    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import quality

    docs = table(spark, sf_dir, "documents")
    machine = quality.learn(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    out = quality.score(docs, machine)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import language_id

    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.learn(docs, crc_mod("doc_id", 4) != 2))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import sentencepieces

    return sentencepieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import warc

    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"), min_revisit_bytes=0))


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
         list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             1 + CAST((CAST('0x' || substr(hex, CAST(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest
  FROM p
), f AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS response FROM d
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < response THEN response END AS refers_to
FROM f
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserine.llm import near_dedup

    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_shards, op2_lm_scoring, op3_token_counts, op4_topk_search, op5_decontaminate, op6_quality, op7_language_id, op8_sentencepieces, op9_warc, op10_near_dedup)}
ORACLES: dict[str, str] = {"op4_topk_search": OP4_SQL, "op9_warc": OP9_SQL}
