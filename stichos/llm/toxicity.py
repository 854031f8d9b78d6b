"""Toxicity: a lexicon trie met by Levenshtein automata, and context windows that tell abuse from quotation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stichos.llm.common import cut, held_out, slices, texts_of
from stichos.llm.quality_rules import labelled_sample

SAMPLE, THRESHOLD = 20_000, 0.5
LEAST_DOCS, LEAST_SHARE, STEM, STEM_FORMS = 5, 0.9, 4, 4
FUZZY_LENGTH, WINDOW = 5, 8
EXACT, STEMMED, FUZZY = 1, 2, 3
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
# words and marks around a term that speak about it (fixed values)
QUOTING = frozenset("said says say saying called calls calling word words term quote quoted quotes wrote writes told means".split())
QUOTES = frozenset("\"'`«»‘’‚“”„")
FEATURES = 8


def normal(word: str) -> str:
    return EDGES.sub("", word)


class Lexicon:
    """Trie of terms and stems; a word is run through the union of the terms' Levenshtein automata of degree 1, made deterministic as it is used.

    A state is the set of (node, errors) reachable with the letters read; a word of a term's length of at least FUZZY_LENGTH may differ by one
    letter more, less or other. A stem accepts its exact letters with anything behind.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = (), plain: Iterable[str] = ()):
        self.terms, self.stems, self.plain = sorted(set(terms)), sorted(set(stems)), frozenset(plain)
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]
        self.stem_at: set[int] = set()
        for word, stem in [(t, False) for t in self.terms] + [(s, True) for s in self.stems]:
            node = 0
            for c in word:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.ends):
                    self.children.append({})
                    self.ends.append(0)
            if stem:
                self.stem_at.add(node)
            else:
                self.ends[node] = len(word)
        self.start = self._closed({(0, 0)})
        self.steps: dict[tuple, dict[str, frozenset | None]] = {}

    def _closed(self, states: set) -> frozenset:
        """With the letters of a term that the word leaves out."""
        out = set(states)
        for node, errors in states:
            if errors == 0:
                out.update((child, 1) for child in self.children[node].values())
        return frozenset(out)

    def _step(self, states: frozenset, c: str) -> frozenset | None:
        out = set()
        for node, errors in states:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, errors))
            if errors == 0:
                out.add((node, 1))
                out.update((other, 1) for other in self.children[node].values())
        return self._closed(out) if out else None

    def match(self, word: str) -> int:
        """EXACT, STEMMED, FUZZY or 0; a plain word (met in clean text) is no misspelling."""
        states, node = self.start, 0
        stemmed = False
        for c in word:
            if node is not None:
                node = self.children[node].get(c)
                stemmed = stemmed or node in self.stem_at
            if states is not None:
                row = self.steps.get(states)
                if row is None:
                    if len(self.steps) > 20_000:
                        self.steps.clear()
                    row = self.steps[states] = {}
                if c in row:
                    states = row[c]
                else:
                    states = row[c] = self._step(states, c)
            if states is None and node is None:
                break
        if node and self.ends[node]:
            return EXACT
        if stemmed:
            return STEMMED
        if states and word not in self.plain and any(self.ends[n] >= FUZZY_LENGTH for n, _ in states):
            return FUZZY
        return 0


class Matches(dict):
    """What the lexicon says of words as they stand in texts; forgets all when it has grown large."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = kind = self.lexicon.match(normal(word))
        return kind


def features_of(text: str, matches: Matches) -> list[float]:
    """Counts of hits by kind outside of quotation, quoted hits, and how thick hits stand: over the text and in the thickest window."""
    words = text.lower().split()
    hits = [(i, kind) for i, kind in enumerate(map(matches.__getitem__, words)) if kind]
    if not hits:
        return [0.0] * FEATURES
    counts, quoted, thickest, at = Counter(), 0, 0, [i for i, _ in hits]
    for i, kind in hits:
        word, near = words[i], words[max(0, i - 3):i]
        marks = (word[0] in QUOTES or (i and words[i - 1][0] in QUOTES)) and (word[-1] in QUOTES or (i + 1 < len(words) and words[i + 1][-1] in QUOTES)
                                                                            or word.rstrip(".,;:!?")[-1:] in QUOTES)
        if marks or any(normal(w) in QUOTING for w in near):
            quoted += 1
        else:
            counts[kind] += 1
    low = 0
    for high in range(len(at)):
        while at[high] - at[low] > 2 * WINDOW:
            low += 1
        thickest = max(thickest, high - low + 1)
    open_ = sum(counts.values())
    return [np.log1p(counts[EXACT]), np.log1p(counts[STEMMED]), np.log1p(counts[FUZZY]), np.log1p(quoted), float(counts[EXACT] + counts[STEMMED] > 0),
            min(1.0, 20 * open_ / max(1, len(words))), np.log1p(thickest), float(open_ == 0)]


def word_counts(sample: DataFrame) -> DataFrame:
    """word, toxic, clean: how many sampled documents of each label have the word, or a word that begins with it (stem true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=1 << 21):
            seen: dict[tuple[str, bool], list[int]] = {}
            for text, label in zip(part.column("text").to_pylist(), part.column("_label").to_pylist()):
                words = {w for w in map(normal, set(text.lower().split())) if len(w) >= STEM}
                for key in {(w, False) for w in words} | {(w[:n], True) for w in words for n in range(STEM, min(len(w), STEM + 4))}:
                    seen.setdefault(key, [0, 0])[1 - label] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.bool_()),
                                              *(pa.array([v[j] for v in seen.values()], pa.int64()) for j in (0, 1))],
                                             names=["word", "stem", "toxic", "clean"])

    return sample.mapInArrow(run, "word string, stem boolean, toxic long, clean long").groupBy("word", "stem") \
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms and stems of toxic documents: in at least LEAST_DOCS of them and with at least LEAST_SHARE of their documents toxic.

    A stem stands for several terms that share its letters. Of texts that are equal but for case and white space one counts. A word near a
    term is plain if at least half of its documents are clean.
    """
    same = F.sha2(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), 256)
    counts = cut(word_counts(sample.withColumn("_same", same).dropDuplicates(["_same", "_label"]).select("text", "_label")))
    good = (F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean")))
    found = counts.filter(good).select("word", "stem").toPandas()
    terms = set(found["word"][~found["stem"].astype(bool)])
    stems = [s for s in found["word"][found["stem"].astype(bool)] if sum(t.startswith(s) for t in terms) >= STEM_FORMS]
    stems = [s for s in stems if not any(s != o and s.startswith(o) for o in stems)]
    lexicon = Lexicon({t for t in terms if not any(t.startswith(s) for s in stems)}, stems)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [w for w in batch.column("word").to_pylist() if lexicon.match(w) == FUZZY]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    plain = counts.filter("not stem and clean > 0 and clean >= toxic").select("word").mapInArrow(near, "word string").toPandas()["word"]
    return Lexicon(lexicon.terms, lexicon.stems, plain)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights and, last, the intercept, by Newton steps on the penalised likelihood."""
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def misspelled(x: np.ndarray) -> np.ndarray:
    """The features that rows with exact hits would have if each of these were misspelled."""
    x = x[x[:, 0] > 0].copy()
    x[:, 2] = np.log1p(np.expm1(x[:, 0]) + np.expm1(x[:, 2]))
    x[:, 0] = 0
    x[:, 4] = x[:, 1] > 0
    return x


def feature_rows(texts: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches = Matches(lexicon)
        for part in slices(batches):
            rows = [features_of(t, matches) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], names=[*keep, "x"])

    types = dict(texts.dtypes)
    return texts.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in keep) + ", x array<double>")


def score_toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Score of every document from the hits of a learned lexicon in its whole text, one row per document.

    Lexicon and weights are learned from at most `rows` labelled documents that are not held out (clean words near a term are kept from being read
    as its misspellings); without both labels every score is 0. A null or empty text has no hits. Rows with the same doc_id, or none, are each
    scored; other columns are not read.
    """
    sample = cut(labelled_sample(docs, labels.filter(~held_out(5, 0)), "toxic", rows))
    lexicon, weights = learn_lexicon(sample), np.zeros(FEATURES + 1)
    learned = feature_rows(sample, lexicon, ["_label"]).toPandas()
    y = learned["_label"].to_numpy(dtype=float)
    if len(set(y)) < 2:
        weights[-1] = -30.0
    else:
        x = np.array(learned["x"].tolist())
        extra = misspelled(x[y == 1])                                 # few sampled texts misspell a term, so the toxic ones are seen so, too
        weights = fit_logistic(np.concatenate([x, extra]), np.concatenate([y, np.ones(len(extra))]))
    z = F.lit(float(weights[-1]))
    for j, w in enumerate(weights[:-1]):
        z = z + F.col("x")[j] * float(w)
    scored = feature_rows(texts_of(docs), lexicon, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
