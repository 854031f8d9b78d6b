"""Whole jobs: scan a corpus, judge its dialects, build the matrix, compare classifiers.

Every stage takes and gives DataFrames. A stage table that several later stages read is
written to Parquet first, so that it is computed once and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stichos.functions import phonemes as ph
from stichos.operators import dialect, learn, lexicon, line_features, matrix, scansion, tokens
from stichos.plans import grid
from stichos.rules import selectors
from stichos.sources import corpus

KEYS = ["text_name", "sub"]


def stage(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def scan_corpus(lines: DataFrame, forms: DataFrame | None = None, entries: DataFrame | None = None,
                stems: DataFrame | None = None, approach: str = scansion.FALLBACK) -> DataFrame:
    """Lines (text_name, book, line, text) to scans with features.

    Without a form table there are no clitics and the letters decide; the native approach
    also needs the dictionary (entries, stems). Parts of a combined text are told apart by source_pos.
    """
    clean = scansion.clean_verses(corpus.drop_pentameters(lines))
    keys = ["text_name", "book", "line", *(["source_pos"] if "source_pos" in lines.columns else [])]
    if forms is None:
        return line_features.line_features(scansion.scan_lines(clean, "text", ph.STUDENT))
    if approach == ph.STUDENT:
        student = scansion.line_sounds(clean, lexicon.student_tokens(forms), keys)
        return line_features.line_features(scansion.scan_lines(student, "sound_text", ph.STUDENT))
    words = lexicon.reading_tokens(forms, entries, stems)
    read = scansion.line_readings(clean, words, keys, {"_native": ("native", ph.NATIVE), "_student": ("student", ph.STUDENT)})
    scans = (scansion.scan_lines(read, "_native", ph.NATIVE) if approach == ph.NATIVE
             else scansion.scan_fallback(read, "_native", "_student"))
    return line_features.line_features(scans)


def judge_dialects(lines: DataFrame, forms: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Dialect counts per text and book, and the same per rule."""
    spark = lines.sparkSession
    counts = stage(tokens.vocabulary(tokens.tokens_of_blocks(lines, ["text_name", "book"]), ["text_name", "book"]), f"{folder}/token_counts")
    known = lexicon.forms_in_vocabulary(forms, counts)
    parses = dialect.with_parse_count(dialect.prepare_parses(known, lexicon.stem_classes(forms)))
    parses = stage(parses, f"{folder}/parses")
    votes = stage(dialect.rule_votes(parses), f"{folder}/votes")
    outcomes = dialect.token_outcomes(parses, dialect.reconcile(votes))
    per_text = dialect.dialect_counts(counts, outcomes)
    per_rule = dialect.rule_counts(counts, dialect.rule_outcomes(votes), ["text_name", "book"])
    per_rule = dialect.with_overall(per_rule, "text_name", "book", ["possible_max", "possible_min", *dialect.BOUND_COLUMNS], ["rule"])
    return stage(per_text, f"{folder}/dialect_counts"), stage(per_rule, f"{folder}/rule_counts")


def feature_matrix(scans: DataFrame, per_text: DataFrame, per_rule: DataFrame) -> DataFrame:
    """The long matrix (text_name, sub, feature_idx, value)."""
    metre = matrix.meter_vector(line_features.meter_counts(scans)).select(*KEYS, "feature_idx", "value")
    long_ = dialect.as_long(per_text, KEYS).unionByName(dialect.as_long(per_rule, KEYS, "rule"))
    words = matrix.dialect_vector(long_, per_text, KEYS).select(*KEYS, "feature_idx", "value")
    return matrix.assemble(metre, words, KEYS)


def classify(long_: DataFrame, folds: DataFrame, cells: list[learn.Cell], folder: str, selector: str = "classify_6",
             width: int | None = None, **kw) -> DataFrame:
    """Prediction log of a selector's rows, below `folder` (see grid.prediction_log). `folds`: (name, fold)."""
    width = width or len(matrix.feature_names())
    rows = selectors.select_rows(matrix.row_vectors(long_, KEYS, width), selectors.SELECTORS[selector])
    rows = learn.as_vectors(rows.join(folds, "name"))
    values = (r[0] for r in folds.filter("fold IS NOT NULL").select("fold").distinct().orderBy("fold").toLocalIterator())
    return grid.prediction_log(rows.select("name", "label", "features", "fold", "is_test"), values, cells, width, folder, **kw)


def corpus_with_combinations(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """All texts that stand alone, combined ones included."""
    texts = corpus.manifest(spark)
    return corpus.without_parts(corpus.combine_texts(lines, texts), texts)


def total_success(scans: DataFrame, spark: SparkSession) -> DataFrame:
    """Scan rates per text; the total leaves out texts that are not counted."""
    flags = corpus.manifest(spark).select("text_name", F.col("skip_for_accuracy").alias("skipped"))
    counted = scans.join(flags, "text_name", "left").withColumn("skipped", F.coalesce("skipped", F.lit(False)))
    return scansion.success_rate(counted, ["text_name", "skipped"], ~F.col("skipped"))
