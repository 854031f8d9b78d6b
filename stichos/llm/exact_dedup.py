"""Exact duplicates by progressive refinement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import NULL_ID, cut, salted_left_join, texts_of

PREFIX_CHARS = 64


def exact_duplicates(docs: DataFrame, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Groups of identical texts: one row per document with the largest doc_id of its group, the row that stays.

    Documents are grouped by length; those that share it by a hash of their first characters; those that share that too by
    the digest of their full content. Each level keeps only the rows of groups that still have two members, so the last
    one groups by content only what the cheap keys could not tell apart. The texts are read once, for the keys and for the
    digest that every row of the result carries; what is shuffled are these keys, never a text.

    A null text is empty, and empty texts are copies of each other. A null doc_id is less than any other; a group whose
    rows have none keeps them all. A row listed twice counts twice, and both are kept if they carry the kept doc_id.
    Groups are counted by partial sums, and their verdict is joined back with salts, so one text may hold any share of the rows.
    """
    keys = cut(texts_of(docs).select(
        "doc_id", F.octet_length("text").alias("_len"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("_prefix"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_row")))                # written with the keys: what spreads rows, with a doc_id or without
    shared = F.col("count") > 1
    by_length = keys.groupBy("_len").count().filter(shared).select("_len", F.lit(True).alias("_same"))
    level1 = salted_left_join(keys, by_length, ["_len"], "_row").filter("_same").drop("_same")
    by_prefix = level1.groupBy("_len", "_prefix").count().filter(shared).select("_len", "_prefix", F.lit(True).alias("_same"))
    level2 = salted_left_join(level1, by_prefix, ["_len", "_prefix"], "_row").filter("_same").drop("_same")
    groups = level2.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")) \
        .filter("group_size > 1")
    out = salted_left_join(keys, groups, ["text_sha256"], "_row")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay; of a row listed twice both (they are one document).

    Null texts are empty ones; rows without doc_id stay if no equal text has one; an empty table stays empty.
    """
    gone = exact_duplicates(docs).filter("not kept").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_k1"), F.col("text_sha256").alias("_k2")).distinct()
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == gone["_k1"]) \
        & (F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256) == gone["_k2"])
    return docs.join(gone, same, "left_anti")
