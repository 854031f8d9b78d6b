"""Corpora derived from the driver tables, in Spark and in SQL.

documents play the corpus: lang is the text, the number in source is the book, and lines
are either the lines of the text or, for scanning, pieces of six words.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORDS6 = r"\S+(?:\s+\S+){0,5}"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str, sf_dir: str | None = None) -> str:
    """A folder for tables that a query writes and reads: the cluster's shared one, or a local one where none is named (tests).

    With sf_dir it is the same for all queries of this application on these tables, else a new one.
    """
    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or f"{tempfile.gettempdir()}/stichos-scratch"
    return f"{shared}/{name}-{sc.applicationId}-{hashlib.md5(sf_dir.encode()).hexdigest()[:12] if sf_dir else uuid.uuid4()}"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("text_name"),
                    F.substr("source", F.lit(4)).cast("int").alias("book"), "text")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(documents(spark, sf_dir))
    return d.select("doc_id", "text_name", "book", F.posexplode(F.split("text", "\n")).alias("_i", "text")) \
        .withColumn("line", F.col("_i") + 1).drop("_i")


def verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(documents(spark, sf_dir))
    return d.select("doc_id", "text_name", "book", F.posexplode(F.regexp_extract_all("text", F.lit(WORDS6), 0)).alias("_i", "text")) \
        .withColumn("line", F.col("_i") + 1).drop("_i")


def spread(d: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores. One small file is one task, and the number of splits says little about a large one: a row group is read by
    the one split that holds its middle, so a file of few row groups leaves most splits empty, whatever its size."""
    want, splits = d.sparkSession.sparkContext.defaultParallelism, d.rdd.getNumPartitions()
    return d.repartition(want if splits < want else max(splits, 4 * want))


def r6(c) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---- the same in SQL ------------------------------------------------------------------------

SQL_DOCS = """docs AS (SELECT doc_id, lang AS text_name, CAST(substr(source, 4) AS INTEGER) AS book, text FROM documents)"""
SQL_LINES = SQL_DOCS + """,
lines AS (SELECT doc_id, text_name, book, unnest(l) AS text, generate_subscripts(l, 1) AS line
          FROM (SELECT doc_id, text_name, book, string_split(text, chr(10)) AS l FROM docs))"""
SQL_VERSES = SQL_DOCS + r""",
lines AS (SELECT doc_id, text_name, book, unnest(l) AS text, generate_subscripts(l, 1) AS line
          FROM (SELECT doc_id, text_name, book, regexp_extract_all(text, '\S+(?:\s+\S+){0,5}') AS l FROM docs))"""

_MARKS = r")(/=\\&+|''"


def sql_decap_token(c: str) -> str:
    low = f"lower({c})"
    return (rf"CASE WHEN regexp_matches({low}, '(?s)^\*[{_MARKS}]+.') THEN "
            rf"regexp_replace({low}, '(?s)^\*([{_MARKS}]+)(.)(.*)$', '\2\1\3') ELSE replace({low}, '*', '') END")


def sql_decap_line(c: str) -> str:
    return rf"replace(regexp_replace(lower({c}), '(^| )\*([{_MARKS}]+)([^ ])', '\1\3\2', 'g'), '*', '')"


def sql_beta(c: str) -> str:
    return rf"regexp_replace({c}, '[^A-Za-z)(/=\\+|''\s*]', ' ', 'g')"


def sql_squeeze(c: str) -> str:
    return rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


def sql_clean_line(c: str) -> str:
    fixed = f"replace(replace({c}, '(??)', 'a('), chr(10), ' ')"
    return f"({sql_squeeze(sql_beta(fixed))} || ' ')"


def sql_clean_block(c: str) -> str:
    t = rf"regexp_replace({c}, '\?|(\d+-(\d+|ff|fin).*?\n)|\d', '', 'g')"
    t = rf"regexp_replace({t}, '\n\*\S*( *|( +(a|b|\*a|\*b)))\n', chr(10), 'g')"
    t = f"replace({t}, '--', ' --')"
    t = rf"regexp_replace({t}, '- *\n', '', 'g')"
    return sql_squeeze(sql_beta(f"replace({t}, chr(10), ' ')"))


_LEAD = r"^\s*([=/\\)(]+)([aehiowur])([^=/\\)(]|$)"
_FLIP = r"([=/\\])([)(])"
_PSTART = r"^\(([a-z])"
_PEND = r"([bcdfgjklmnpqrstvxyz][iu]|[a-z][abcdefghjklmnopqrstvwxyz])\("


def sql_standardize_ctes(source: str, raw: str, keep: str) -> str:
    """CTE `std`: keep columns and token, by steps."""
    return rf"""
s0 AS (SELECT {keep}, {sql_decap_token(raw)} AS t0 FROM {source}),
s1 AS (SELECT *, CASE WHEN regexp_matches(t0, '{_LEAD}') THEN regexp_replace(t0, '{_LEAD}', '\2\1\3') ELSE t0 END AS t1 FROM s0),
s2 AS (SELECT *, CASE WHEN regexp_matches(t0, '{_FLIP}') THEN regexp_replace(t1, '{_FLIP}', '\2\1', 'g') ELSE t1 END AS t2 FROM s1),
s3 AS (SELECT *, CASE WHEN regexp_matches(t0, '{_PSTART}') THEN regexp_replace(t2, '{_PSTART}', '\1') ELSE t2 END AS t3 FROM s2),
s4 AS (SELECT *, CASE WHEN regexp_matches(t0, '{_PEND}') THEN regexp_replace(t3, '{_PEND}', '\1', 'g') ELSE t3 END AS t4 FROM s3),
std AS (SELECT {keep}, replace(CASE WHEN t4 = 'dia/doxa/' THEN t4 ELSE
        regexp_replace(t4, '^([^/=]*[/=][^/=]*)/([^/=]*).*$', '\1\2') END, '\', '/') AS token FROM s4)"""


def sql_strip(c: str) -> str:
    return rf"translate({c}, ')(/=\&+|''0123456789', '')"


SQL_TOKENS = SQL_LINES + f""",
cl AS (SELECT doc_id, text_name, book, line, {sql_clean_line(sql_decap_line('text'))} AS clean FROM lines),
tk AS (SELECT * FROM (SELECT doc_id, text_name, book, line, unnest(string_split(clean, ' ')) AS raw FROM cl) WHERE raw <> ''),
{sql_standardize_ctes('tk', 'raw', 'doc_id, text_name, book, line')}"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stichos.operators.tokens import tokens_of_lines
    return tokens_of_lines(doc_lines(spark, sf_dir), ["doc_id", "text_name", "book", "line"])


def token_counts(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """How often each token of the documents occurs per group."""
    from stichos.operators.tokens import counted, words_of_lines
    return counted(words_of_lines(doc_lines(spark, sf_dir), by), by)
