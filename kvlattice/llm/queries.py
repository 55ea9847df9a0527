"""Queries of this subpackage, and their SQL where DuckDB can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_naming, language_id, license_scan, ngram_join, packing, pivot_topk, prefix_bpe, role_repair, suffix_dedup, token_stream
from .common import documents, prepare

ALPHABETS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return pivot_topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(documents(spark, sf_dir))


def op4_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.format_chats(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return prefix_bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op7_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stream = token_stream.write_stream(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return token_stream.read_documents(stream, spark)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(documents(spark, sf_dir))


OP8_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {ALPHABETS}) AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pivot_topk": op1_pivot_topk,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_role_repair": op4_role_repair,
        "op5_prefix_bpe": op5_prefix_bpe,
        "op6_ngram_join": op6_ngram_join,
        "op7_token_stream": op7_token_stream,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_language_id": op9_language_id,
        "op10_harmonic_packing": op10_harmonic_packing,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": OP1_SQL, "op8_exact_dedup": OP8_SQL}
