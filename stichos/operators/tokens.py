"""Token streams and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stichos.functions import text as tx


def tokens_of_lines(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """N-10: cleaned line text and its standardised tokens, one row per token.

    Standardising is narrow, no join. Empty tokens (from
    the final blank) are dropped.
    """
    return tx.standardized(words_of_lines(lines, keys, text))


def words_of_lines(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """N-10 up to the words as written."""
    clean = lines.select(*keys, tx.clean_verse(text).alias("clean"))
    return clean.select(*keys, F.posexplode(F.split("clean", " ")).alias("pos", "raw")).filter("raw <> ''")


def tokens_of_blocks(lines: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """N-11: tokens after the block cleaner, per line and without building a block."""
    words = lines.select(*keys, F.posexplode(F.split(tx.clean_block(text), " ")).alias("pos", "raw"))
    return tx.standardized(words.filter("raw <> ''"))


def tokens_of_wrapped_blocks(lines: DataFrame, keys: list[str], line: str = "line", text: str = "text") -> DataFrame:
    """N-11 with words that a hyphen wraps over a line end put together, at the place of their first part.

    Every line sends its first word to the line before it, and word whether it ends in a hyphen to the line after it: two narrow rows that meet
    their line in one grouping by (keys, line), so no window holds a book. A first word is what stands before the first blank; a line that begins with
    a blank has none to give, and a line that is one wrapped word keeps it and goes on with the next line's.
    """
    raw = tx.block_text(text)
    wraps = raw.rlike(r"- *$")
    first = F.when(raw.rlike(r"^[^\s]*- *$"), "").otherwise(F.regexp_extract(raw, r"^[^\s]*", 0))
    cells = F.array(
        F.struct((F.col(line)).alias("_at"), raw.alias("_text"), F.lit(None).cast("string").alias("_next"), F.lit(None).cast("boolean").alias("_taken")),
        F.struct((F.col(line) - 1).alias("_at"), F.lit(None).cast("string").alias("_text"), first.alias("_next"), F.lit(None).cast("boolean").alias("_taken")),
        F.struct((F.col(line) + 1).alias("_at"), F.lit(None).cast("string").alias("_text"), F.lit(None).cast("string").alias("_next"), wraps.alias("_taken")))
    sent = lines.select(*keys, F.inline(cells))
    met = sent.groupBy(*keys, "_at").agg(F.max("_text").alias("_text"), F.max("_next").alias("_next"), F.max("_taken").alias("_taken")).filter("_text IS NOT NULL")
    own = F.when(F.coalesce("_taken", F.lit(False)) & ~F.col("_text").rlike(r"^[^\s]*- *$"), F.regexp_replace("_text", r"^[^\s]*", "")).otherwise(F.col("_text"))
    whole = F.when(own.rlike(r"- *$"), F.concat(F.regexp_replace(own, r"- *$", ""), F.coalesce("_next", F.lit("")))).otherwise(own)
    words = met.select(*keys, F.col("_at").alias(line), F.posexplode(F.split(tx.block_words(whole), " ")).alias("pos", "raw"))
    return tx.standardized(words.filter("raw <> ''"))


def vocabulary(tokens: DataFrame, by: list[str] | None = None) -> DataFrame:
    """N-12: distinct tokens with their counts; sort only when a report needs it."""
    return tokens.groupBy(*(by or []), "token").agg(F.count("*").alias("n"))


def token_counts(tokens: DataFrame, by: list[str]) -> DataFrame:
    """N-13: tokens and distinct tokens per group.

    Counting types first turns the distinct count into a plain count: one shuffle carries
    (group, token, n) rows, never a set per group.
    """
    types = vocabulary(tokens, by)
    return types.groupBy(*by).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_unique"))


def lookup_failures(vocab: DataFrame, forms: DataFrame) -> DataFrame:
    """N-14: how many distinct tokens have no parse. `forms`: one row per (token, parse)."""
    known = forms.select("token").distinct().withColumn("_known", F.lit(True))
    looked = vocab.select("token").distinct().join(known, "token", "left")
    return looked.agg(F.count_if(F.col("_known").isNull()).alias("n_failed"), F.count("*").alias("n_total"))


def join_types(facts: DataFrame, types: DataFrame, on: list[str]) -> DataFrame:
    """Left join of occurrences to the rows of their types; facts are counts per group, so a frequent type is a row per group, and the
    types, which grow with the vocabulary, are sent once. Partitions that are still large are split by Spark (adaptive skew joins)."""
    return facts.join(types, on, "left")


def counted(words: DataFrame, by: list[str]) -> DataFrame:
    """N-8 and N-12 on words as written (`raw`): each spelling is counted first and standardised once per group, then tokens are summed up.

    The sums are spread over all shuffle partitions: they are few bytes, but what follows computes a lot for each token."""
    spelled = words.groupBy(*by, "raw").agg(F.count("*").alias("n"))
    spread = tx.standardized(spelled).repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "token")
    return spread.groupBy(*by, "token").agg(F.sum("n").alias("n"))
