"""A corpus prepared for training: filtered, deduplicated three times and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stichos.llm import exact_dedup, near_dedup, packing, quality_rules, suffix_dedup
from stichos.llm.common import cut, load, vocabulary_file

SHINGLE_WORDS, SIMILARITY = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from labels; null and empty texts do not."""
    return quality_rules.keep_documents(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id (rows without any stay if no equal text has one)."""
    return exact_dedup.one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of a similarity of 0.8 or more (shingles of five words) the one with the least doc_id.

    Documents without doc_id or without words are linked with nothing and stay.
    """
    return near_dedup.one_of_each_class(docs, SHINGLE_WORDS, SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 100 bytes that start earlier, too; a text may come out empty, and stays a document."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens; an empty text is its end token. Of an empty table every stage gives an empty one."""
    from public_tokenizers import PATTERN

    return packing.pack_documents(docs, vocabulary_file("byte_bpe_50k.json"), PATTERN)


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("minhash_near_dedup", near), ("suffix_array_dedup", repeats), ("packing", pack)]

# The decision list is learned and the packing retrieves neighbours: no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
