"""From documents to packed training sequences, in five stages.

Each stage is (name, function(spark, docs, sf_dir)): it reads all rows that the
one before has kept and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of
documents.

Near-duplicate settings are those of language-model corpora: shingles of five
words and a similarity of 0.8 or more.

Defined cases, beside those of the operators: null texts and texts without a
letter go in the first stage; repeated rows are one after the second; rows
without doc_id, or with one that others have, are told apart by their texts;
texts that a removed passage leaves empty stay, with their end id; further
columns, whatever their names, are passed on up to the last stage; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kvlattice.llm import block_naming, language_id, ngram_join, packing, suffix_dedup
from kvlattice.llm.common import materialize, prepare

NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Rows differ by learned models, hashes and packing; see tests/llm.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with enough confidence."""
    prepare(spark)
    return language_id.keep_identified(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    prepare(spark)
    return block_naming.keep_one(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    prepare(spark)
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier text has already."""
    prepare(spark)
    return suffix_dedup.remove_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("exact_dedup", dedup_exact),
    ("ngram_join", dedup_near),
    ("suffix_dedup", dedup_passages),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
