"""Corpora as tables: reading, shaping and writing (C-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from stichos.sources.json_arrays import json_elements

VERSE_LINE = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("poem", T.StringType()),
    T.StructField("book", T.IntegerType()), T.StructField("line", T.IntegerType())])

PARSE_FIELDS = ("form", "lemma", "pos", "expandedForm", "dialect", "feature", "case", "number",
                "gender", "tense", "mood", "voice", "person")
PARSE = T.StructType([T.StructField(f, T.StringType()) for f in PARSE_FIELDS])

# Editorial marks: daggers, square brackets, angle brackets.
EDITORIAL = r"((†|&#8224;).*?(†|&#8224;))|(\[.*?\])|(<.*?>)"

MANIFEST_TYPE = ("text_name string, author string, num_books int, increments array<int>, divide_by_book boolean, "
                 "skip_for_accuracy boolean, is_combined boolean, to_be_combined boolean, source_texts array<string>")

# The corpus. Name, author, books, divided by book, not counted for accuracy, combined, part of a combination, sources.
MANIFEST = (
    ("Iliad", "Homer", 24, True, False, False, False, ()),
    ("Odyssey", "Homer", 24, True, False, False, False, ()),
    ("Hymns", "Anonymous", 33, False, False, False, False, ()),
    ("HymnsLong", "Anonymous", 5, True, True, False, False, ()),
    ("HymnsShort", "Anonymous", 1, False, True, False, False, ()),
    ("CallimachusHymns", "Callimachus", 6, False, False, False, False, ()),
    ("Abduction of Helen", "Colluthus", 1, False, False, False, False, ()),
    ("Shield of Heracles", "Hesiod", 1, False, False, False, False, ()),
    ("Theogony", "Hesiod", 1, False, False, False, False, ()),
    ("Works and Days", "Hesiod", 1, False, False, False, False, ()),
    ("Epitaphius Bios", "Moschus", 1, False, False, False, True, ()),
    ("Eros Drapeta", "Moschus", 1, False, False, False, True, ()),
    ("Europa", "Moschus", 1, False, False, False, True, ()),
    ("Megara", "Moschus", 1, False, False, False, True, ()),
    ("Dionysiaca", "Nonnus of Panopolis", 48, True, False, False, False, ()),
    ("Cynegetica", "Oppian of Apamea", 4, True, False, False, False, ()),
    ("Halieutica", "Oppian", 5, True, False, False, False, ()),
    ("Fall of Troy", "Quintus Smyrnaeus", 14, True, False, False, False, ()),
    ("Idylls_Eidulia", "Theocritus", 30, False, False, False, True, ()),
    ("Idylls_Epigrams", "Theocritus", 24, False, False, False, True, ()),
    ("The Taking of Ilios", "Tryphiodorus", 1, False, False, False, False, ()),
    ("Argonautica", "Apollonius Rhodius", 4, True, False, False, False, ()),
    ("Phaenomena", "Aratus Solensis", 1, False, False, False, False, ()),
    ("Epithalamium Achillis et Deidameiae", "Bion of Phlossa", 1, False, False, False, True, ()),
    ("Epitaphius Adonis", "Bion of Phlossa", 1, False, False, False, True, ()),
    ("Fragmenta", "Bion of Phlossa", 1, False, False, False, True, ()),
    ("Works of Moschus", "Moschus", 1, False, False, True, False, ("Epitaphius Bios", "Eros Drapeta", "Europa", "Megara")),
    ("Idylls", "Theocritus", 1, False, False, True, False, ("Idylls_Eidulia", "Idylls_Epigrams")),
    ("Works of Bion", "Bion of Phlossa", 1, False, False, True, False, ("Epithalamium Achillis et Deidameiae", "Epitaphius Adonis", "Fragmenta")),
    ("Iliad1", "Homer", 1, False, True, False, False, ()),
    ("Odyssey1", "Homer", 1, False, True, False, False, ()),
)

# First line of every page for texts that are split into pages (cards) or
# that use only some of their numbered pieces.
INCREMENTS = {
    "HymnsShort": [6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33],
    "Shield of Heracles": [1, 39, 78, 115, 154, 178, 216, 245, 280, 327, 365, 402, 443],
    "Theogony": [1, 29, 53, 63, 104, 139, 173, 207, 240, 270, 304, 337, 371, 404, 453, 492, 507, 545, 585, 617,
                 645, 687, 729, 767, 807, 820, 853, 886, 901, 938, 963, 1003],
    "Works and Days": [1, 11, 42, 59, 83, 109, 140, 174, 202, 238, 274, 320, 370, 405, 448, 479, 504, 536, 571,
                       609, 641, 678, 706, 737, 765, 800],
    "Fragmenta": [3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18],
}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """C-1: verse lines from Parquet, from JSON with one object per line (.jsonl), or from files of JSON arrays; all are read in splits."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".jsonl"):
        return spark.read.schema(VERSE_LINE).json(path)
    return json_elements(spark, path).select(F.from_json("value", VERSE_LINE).alias("v")).select("v.*")


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """C-9: form table, a JSON array of [token, [parse, ...]] of any size, as one row per (token, parse)."""
    pairs = json_elements(spark, path).select(F.from_json("value", T.ArrayType(T.StringType())).alias("pair"))
    parsed = pairs.select(F.col("pair")[0].alias("token"),
                          F.from_json(F.col("pair")[1], T.ArrayType(PARSE)).alias("parses"))
    return explode_forms(parsed)


def explode_forms(indexed: DataFrame) -> DataFrame:
    """One row per (token, parse_no); a token without parses keeps no row."""
    return (indexed.select("token", F.posexplode("parses").alias("parse_no", "p"))
            .select("token", "parse_no", "p.*"))


def manifest(spark: SparkSession) -> DataFrame:
    """C-2: one row per text."""
    rows = [(name, author, books, INCREMENTS.get(name), divided, skipped, combined, part, list(sources) or None)
            for name, author, books, divided, skipped, combined, part, sources in MANIFEST]
    return spark.createDataFrame(rows, MANIFEST_TYPE)


def counted_texts(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """C-2 as a filter: lines of texts that count for accuracy and stand alone."""
    keep = texts.filter(~F.col("skip_for_accuracy") & ~F.col("to_be_combined")).select("text_name")
    return lines.join(keep, "text_name", "left_semi")


def combine_texts(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """C-3: add the combined texts. `texts` has text_name and source_texts.

    The lines are read once; every line is repeated under each text that takes it up.
    (source_pos, book, line) keeps the order.
    """
    parts = texts.filter(F.col("source_texts").isNotNull()).select(
        F.col("text_name").alias("combined"), F.posexplode("source_texts").alias("source_pos", "text_name"))
    added = (lines.join(parts, "text_name")
             .withColumn("text_name", F.col("combined")).drop("combined"))
    return lines.withColumn("source_pos", F.lit(0)).unionByName(added.select(*lines.columns, "source_pos"))


def without_parts(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """C-4: drop texts that only serve a combination."""
    parts = texts.filter("to_be_combined").select("text_name")
    return lines.join(parts, "text_name", "left_anti")


def lines_of_markup(pages: DataFrame, keys: list[str], markup: str, first_line: Column | None = None,
                    line_tag: str = "l", block_tag: str = "p", break_tag: str = "lb") -> DataFrame:
    """C-5, C-6: verse lines of marked-up pages.

    Every line element is a line. A page without any is split at line breaks inside its
    blocks; there notes, tags, digits and blank lines go. Lines count up from the first
    line of the page (1 unless the page says otherwise).
    """
    body = F.col(markup)

    def inner(tag: str) -> Column:
        return F.regexp_extract_all(body, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)

    def bare(c: Column) -> Column:
        no_notes = F.regexp_replace(c, r"(?s)<note.*?/note>", "")
        return F.regexp_replace(no_notes, r"(?s)<[^>]*>", "")

    pieces = F.flatten(F.transform(inner(block_tag), lambda b: F.split(
        F.regexp_replace(b, r"(?s)<note.*?/note>", ""), rf"<{break_tag}")))
    # a piece after a break starts inside the break tag
    from_blocks = F.transform(pieces, lambda x: F.translate(
        F.regexp_replace(F.regexp_replace(x, r"(?s)^[^<>]*>", ""), r"(?s)<[^>]*>", ""), "0123456789", ""))
    shaped = (F.when(F.size(inner(line_tag)) > 0, F.transform(inner(line_tag), bare))
              .otherwise(F.filter(from_blocks, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")))
    start = F.lit(1) if first_line is None else first_line
    return (pages.select(*keys, start.cast("int").alias("_first"), F.posexplode(shaped).alias("_i", "text"))
            .select(*keys, (F.col("_first") + F.col("_i")).alias("line"), "text"))


def number_lines(lines: DataFrame, within: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """C-6 where pages carry no start: running line number over the pages of a book.

    Counts per page are summed first and, in two levels, over pages: pages are dealt to ranges by quantiles of the page key over all lines,
    summed within a range, and the ranges of a book summed before each. There are as many ranges as a shuffle has partitions, so a window holds the pages of
    one partition's share of the lines, or one row per range; the number is the page's offset plus the position in the page.
    `order` = [page key, position]; the page key is a number.
    """
    ranges = max(2, ranges or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    page, pos = order
    sizes = lines.groupBy(*within, page).agg(F.count("*").alias("_n"))
    cuts = lines.agg(F.percentile_approx(page, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("_cuts")).select(F.array_distinct("_cuts").alias("_cuts"))
    ranged = sizes.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda x: x < F.col(page)))).drop("_cuts")
    totals = ranged.groupBy(*within, "_range").agg(F.sum("_n").alias("_total"))
    totals = totals.withColumn("_start", F.sum("_total").over(Window.partitionBy(*within).orderBy("_range")) - F.col("_total")).drop("_total")
    inside = F.sum("_n").over(Window.partitionBy(*within, "_range").orderBy(page)) - F.col("_n")
    offsets = ranged.withColumn("_inside", inside).join(totals, [*within, "_range"]) \
        .select(*within, page, (F.col("_start") + F.col("_inside")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*within, page).orderBy(pos))
    return (lines.withColumn("_rank", rank).join(offsets, [*within, page])
            .withColumn("line", (F.col("_before") + F.col("_rank")).cast("long")).drop("_rank", "_before"))


def editorial_marks(lines: DataFrame, text: str = "text") -> DataFrame:
    """C-7: lines with daggers or brackets, and the first marked passage."""
    return (lines.filter(F.col(text).rlike(EDITORIAL))
            .withColumn("passage", F.regexp_extract(text, EDITORIAL, 0)))


def drop_pentameters(lines: DataFrame, text: str = "CallimachusHymns", book: int = 5) -> DataFrame:
    """C-8: every even line of one book of one text is no hexameter."""
    couplet = (F.col("text_name") == text) & (F.col("book") == book) & (F.col("line") % 2 == 0)
    return lines.filter(~F.coalesce(couplet, F.lit(False)))


def overlay(base: DataFrame, supplement: DataFrame, key: str) -> DataFrame:
    """C-10: entries of the supplement replace those of the base.

    Whole entries change hands: an anti join and a union, no window over a key.
    """
    kept = base.join(supplement.select(key).distinct(), key, "left_anti")
    return kept.unionByName(supplement)


def read_feet(spark: SparkSession, path: str, text_name: str, first_line: int = 1) -> DataFrame:
    """C-11: ground-truth feet, one line of five letters per verse line.

    The number comes from the position inside the file, which one task reads whole (the
    file of a text holds at most a few thousand lines).
    """
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.posexplode(F.split(F.rtrim(F.replace("value", F.lit("\r"), F.lit(""))), "\n"))
                        .alias("_i", "feet5"))
    return rows.select(F.lit(text_name).alias("text_name"), (F.col("_i") + first_line).alias("line"),
                       F.trim("feet5").alias("feet5")).filter("feet5 <> ''")


def write_by_text(df: DataFrame, path: str, text: str = "text_name", mode: str = "overwrite") -> None:
    """C-12: results partitioned by text, so that later readers prune.

    The rows of a text come together, and adaptive execution splits a large text by size, so that many tasks write it.
    """
    df.hint("rebalance", text).write.mode(mode).partitionBy(text).parquet(path)
