"""Quality rules: text statistics and a decision list learned from labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stichos.llm.common import ship, slices, texts_of

SPACE, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
UPPER, DIGITS, STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?.,;:"
NGRAM, SAMPLE = 8, 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct", "n_upper", "n_digits", "n_stops", "n_lines")
STATS = ", ".join(f"{c} long" for c in ("doc_id", *COUNTS, *MORE))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], n: int = NGRAM) -> int:
    """Words in n-word windows that are found twice or more among the words."""
    if len(words) <= n:
        return 0
    w = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = (w ^ (w >> np.uint64(29))) * MULTIPLIER
    h = w[:len(w) - n + 1].copy()
    for k in range(1, n):
        h = (h ^ (h >> np.uint64(31))) * MULTIPLIER + w[k:len(w) - n + 1 + k]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    edge = np.zeros(len(w) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics_of(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    without = lambda chars: len(data) - len(data.translate(None, chars))
    return (len(words), len(text) - without(SPACE), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
            len(set(words)), without(UPPER), without(DIGITS), without(STOPS), len(lines))


def text_statistics(docs: DataFrame) -> DataFrame:
    """Counts over whole texts, one row per document; a null text has none (all zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *COUNTS, *MORE]
        for part in slices(batches):
            rows = [statistics_of(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=names)

    return texts_of(docs).mapInArrow(run, STATS)


# What a rule may test: ratios of the counts.
FEATURES = {
    "words": ("n_words", None), "word_length": ("word_chars", "n_words"), "symbols": ("n_symbols", "n_words"),
    "repeated": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "distinct": ("n_distinct", "n_words"),
    "upper": ("n_upper", "word_chars"), "digits": ("n_digits", "word_chars"), "stops": ("n_stops", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


Source = Callable[[str], Column]


def feature(name: str, of: Source = F.col) -> Column:
    top, bottom = FEATURES[name]
    value = of(top).cast("double")
    return value if bottom is None else F.when(of(bottom) > 0, value / of(bottom)).otherwise(F.lit(0.0))


def base_failed(of: Source = F.col) -> Column:
    return (of("n_words") < 20) | (100 * of("n_repeat_words") > 30 * of("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self, of: Source = F.col) -> Column:
        value = feature(self.feature, of)
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    """Documents that meet all conditions are rejected."""

    conditions: tuple[Condition, ...]

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.of(x) for c in self.conditions])

    def column(self, of: Source = F.col) -> Column:
        out = self.conditions[0].column(of)
        for c in self.conditions[1:]:
            out = out & c.column(of)
        return out


def _precision(covered: np.ndarray, bad: np.ndarray) -> float:
    """Laplace's estimate of the share of bad rows among the covered."""
    return ((covered & bad).sum() + 1) / (covered.sum() + 2)


def _grow(x: dict, bad: np.ndarray, most: int = 4) -> Rule | None:
    covered, conditions = np.ones(len(bad), dtype=bool), []
    while len(conditions) < most and (covered & ~bad).any():
        p, n = (covered & bad).sum(), covered.sum()
        best, gain = None, 1e-9
        for name, values in x.items():
            cuts = np.unique(np.quantile(values[covered], np.linspace(0, 1, 65)))
            cuts = (cuts[1:] + cuts[:-1]) / 2
            for above in (False, True):
                for cut in cuts:
                    c = Condition(name, above, float(cut))
                    now = covered & c.of(x)
                    p1, n1 = (now & bad).sum(), now.sum()
                    if p1 and n1 < n and (g := p1 * (np.log2(p1 / n1) - np.log2(p / n))) > gain:
                        best, gain = c, g
        if best is None:
            break
        conditions.append(best)
        covered &= best.of(x)
    return Rule(tuple(conditions)) if conditions else None


def _prune(rule: Rule, x: dict, bad: np.ndarray) -> Rule:
    """Drops last conditions as long as that does not lower the precision on rows kept apart."""
    while len(rule.conditions) > 1:
        shorter = Rule(rule.conditions[:-1])
        if _precision(shorter.of(x), bad) < _precision(rule.of(x), bad):
            break
        rule = shorter
    return rule


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, least_precision: float = 0.95, least_rows: int = 5) -> list[Rule]:
    """Sequential covering: grow a rule on two thirds of the rows, prune it on the rest, take out what it covers, go on.

    A rule enters the list if at least `least_rows` rows meet it and its estimated precision over all remaining rows reaches
    `least_precision`; the first that does not ends the list.
    """
    rules, left = [], np.ones(len(bad), dtype=bool)
    while (left & bad).sum() >= least_rows:
        rows = np.flatnonzero(left)
        grow, prune = rows[np.arange(len(rows)) % 3 > 0], rows[np.arange(len(rows)) % 3 == 0]
        pick = lambda at: {k: v[at] for k, v in x.items()}
        rule = _grow(pick(grow), bad[grow])
        if rule is None:
            break
        rule = _prune(rule, pick(prune), bad[prune])
        covered = rule.of(x) & left
        if (covered & bad).sum() < least_rows or _precision(covered, bad & left) < least_precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents, those with the least hash of doc_id.

    The bound makes the broadcast one of at most `rows` pairs of numbers.
    """
    picked = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()) \
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_label"))
    picked = picked.groupBy("doc_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    return texts_of(docs).join(F.broadcast(picked), "doc_id")


def learn_from_labels(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> list[Rule]:
    """Decision list from the statistics of a bounded sample of labelled documents that pass the base rules."""
    sample = labelled_sample(docs, labels, "quality", rows)
    stats = text_statistics(sample).filter(~base_failed()).select("doc_id", *(feature(f).alias(f) for f in FEATURES))
    marks = sample.select("doc_id", "_label").distinct()
    table = stats.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas()
    x = {f: table[f].to_numpy(dtype=float) for f in FEATURES}
    return learn_rules(x, table["_label"].to_numpy() == 0)


def verdict(rules: list[Rule], of: Source = F.col) -> Column:
    """The ordered conditional expression of a decision list: true if no rule rejects."""
    out = None
    for rule in rules:
        out = F.when(rule.column(of), False) if out is None else out.when(rule.column(of), False)
    return F.lit(True) if out is None else out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Statistics, base verdict and verdict of the learned list, one row per document.

    The list is learned from at most `rows` labelled documents; without labels, or if no rule is good enough, it is empty
    and keeps all that pass the base rules. Documents are then judged in one narrow pass. A null or empty text has no words and
    fails the base rules; rows with the same doc_id, or none, are each judged; other columns are not read.
    """
    rules = learn_from_labels(docs, labels, rows)
    stats = text_statistics(docs).withColumn("base_failed", base_failed())
    return stats.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def keep_documents(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns, that pass the base rules and the learned list; a narrow pass.

    Null and empty texts fail the base rules; rows without doc_id and rows listed twice are judged by their text like others; an empty table
    stays empty. Of rules that cover the same rows the one grown first is tried first.
    """
    ship(docs.sparkSession)
    rules, names, column = learn_from_labels(docs, labels, rows), [*COUNTS, *MORE], "_statistics"
    while column in docs.columns:
        column += "_"

    @F.pandas_udf(", ".join(f"{c} long" for c in names))
    def statistics(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([statistics_of(t or "") for t in text], columns=names)

    of = lambda name: F.col(column)[name]
    return docs.withColumn(column, statistics("text")).filter(~base_failed(of) & verdict(rules, of)).drop(column)
