"""Dictionary entries (X-9 ... X-17)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stichos.functions import phonemes as ph
from stichos.functions.text import _col
from stichos.rules.references import CROSS_REFERENCES

SENSE = "$$"


def headword(core) -> Column:
    """X-9: first word without punctuation; a hyphen stays only at its end."""
    first = F.translate(F.split_part(_col(core), F.lit(" "), F.lit(1)), ",.:", "")
    return F.concat(F.translate(first, "-", ""), F.when(F.endswith(first, F.lit("-")), "-").otherwise(""))


def core_text(entry) -> Column:
    """X-10: mark the first sense, drop tags, a blank after every comma."""
    t = F.regexp_replace(F.concat(F.lit("\n"), _col(entry)), r"(?s)^\n(.*?)<sense", r"$1\$\$<sense")
    t = F.regexp_replace(F.regexp_replace(t, r"^\n", ""), "<[^>]*>", "")
    t = F.regexp_replace(t, r",([^\s])", ", $1")
    return F.replace(F.replace(t, F.lit("&#65288;"), F.lit("(")), F.lit("&#65289;"), F.lit(")"))


# Where the grammatical head of an entry ends. The gender words close a head
# that the first sense would cut short.
_GENDER = r"(o\(|h\(|to/|oi\(|ai\(|ta/)"
VERB_HEAD = r"(^\S*w[,\s])|(^\S*o/?mai[,\s])"
HEAD_ENDS = (
    r"^\S* \(\$\$.*?\), " + _GENDER,
    r"^\S*( \[[^\]]*\])?, \S+os \((also )?\$\$.*?\), " + _GENDER,
    r"^\S*( or \S*)? \((cf\. )?\$\$.*?\)( \[[^\]]*\])?, Adv\.",
    r"^\S*( \[[^\]]*\])?(, \S*os)? \(.*?\$\$.*?\), " + _GENDER + r"[,.\s]",
)
GENDER_AFTER_SENSE = r"\$\$, " + _GENDER + r"[,.\s]"


def grammar_head(core) -> Column:
    """X-11: the start of an entry that tells its grammar; the first way that fits."""
    c = _col(core)
    upto = lambda text, mark: F.substring_index(text, mark, 1)
    ways = [F.when(c.rlike(VERB_HEAD) & F.contains(c, F.lit(dash)), upto(c, dash)) for dash in (":—", ":&#8212;")]
    ways += [F.when(c.rlike(p), F.regexp_extract(c, p, 0)) for p in HEAD_ENDS]
    ways.append(F.when(c.rlike(GENDER_AFTER_SENSE), F.regexp_extract(c, r"(?s)^.*?" + GENDER_AFTER_SENSE, 0)))
    ways.append(F.when(c.rlike(r"^\S*:"), upto(c, ":")))
    ways.append(F.when(F.contains(c, F.lit(SENSE)), upto(c, SENSE)))
    return F.coalesce(*ways, upto(c, ":"))


def _pointing(patterns, core: str) -> list[Column]:
    bare = F.replace(F.col(core), F.lit(SENSE), F.lit(""))
    return [F.coalesce((bare if no_sense else F.col(core)).rlike(pattern), F.lit(False)) for pattern, no_sense in patterns]


def without_cross_references(entries: DataFrame, patterns=CROSS_REFERENCES, core: str = "core") -> DataFrame:
    """X-12: drop entries that only point to another one.

    patterns: (regex, whether the sense mark is taken out first). All are literals in one
    filter, so each is compiled once per task.
    """
    return entries.filter(~reduce(or_, _pointing(patterns, core)))


def cross_reference_hits(entries: DataFrame, patterns=CROSS_REFERENCES, core: str = "core") -> DataFrame:
    """How many entries each pattern takes: (pattern, n), in one pass."""
    counts = entries.agg(*[F.count_if(hit).alias(f"_{k}") for k, hit in enumerate(_pointing(patterns, core))])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("pattern"), F.col(f"_{k}").alias("n")) for k in range(len(patterns))])))


def classify(entries: DataFrame, exact: DataFrame | None, rounds: list[list[tuple[str, str, str]]],
             head: str = "head", word: str = "headword", other: str = "other") -> DataFrame:
    """X-13: class per entry: its word's own class, else over the patterns of the first
    round that match the one whose match ends first (ties: earlier rule), and so on.

    rounds: lists of (regex, class, column to match).
    """
    def first_end(rules):
        cells = []
        for no, (pattern, cls, column) in enumerate(rules):
            c = F.col(column)
            # where the first match ends: everything before it plus the match itself
            end = F.length(F.regexp_extract(c, rf"(?s)^.*?(?-s:{pattern.lstrip('^')})" if not pattern.startswith("^")
                                            else pattern, 0))
            cells.append(F.when(c.rlike(pattern), F.struct(end.alias("end"), F.lit(no).alias("no"), F.lit(cls).alias("cls"))))
        return F.array_min(F.filter(F.array(*cells), lambda x: x.isNotNull()))["cls"]

    prepared = entries
    own = F.lit(None).cast("string")
    if exact is not None:
        prepared = entries.join(exact.select(F.col("word").alias(word), F.col("class").alias("_own")), word, "left")
        own = F.col("_own")
    return (prepared.withColumn("class", F.coalesce(own, *[first_end(r) for r in rounds], F.lit(other)))
            .drop("_own"))


def required_literal(pattern: str) -> str:
    """The longest text that every match of the pattern holds; empty if none is sure.

    Read from the pattern's parts in a row: characters, and what stands in groups and repetitions that must occur.
    """
    from re import _parser

    runs = [""]

    def walk(parts) -> None:
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                runs[-1] += chr(value)
                continue
            if name == "SUBPATTERN" and not value[1]:                  # no flags of its own
                walk(value[3])
                continue
            if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
                runs.append("")
                walk(value[2])
            if name != "AT":                                           # ^ and \b take no room
                runs.append("")

    parsed = _parser.parse(pattern)
    if parsed.state.flags & re.IGNORECASE:
        return ""
    walk(parsed)
    return max(runs, key=len)


class RuleTable:
    """Many rules (regex, class, column) as one automaton over the literals that their matches need.

    One walk over a text finds the literals in it and so the few rules that can match; only these are tried, each once.
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        import ahocorasick

        self.rules = [(re.compile(pattern), cls, column) for pattern, cls, column in rules]
        self.columns = sorted({column for _, _, column in rules})
        self.always: dict[str, list[int]] = {c: [] for c in self.columns}
        needs: dict[str, dict[str, list[int]]] = {c: {} for c in self.columns}
        for no, (pattern, _, column) in enumerate(rules):
            literal = required_literal(pattern)
            (needs[column].setdefault(literal, []) if literal else self.always[column]).append(no)
        self.automata = {}
        for column, literals in needs.items():
            if literals:
                found = self.automata[column] = ahocorasick.Automaton()
                for literal, numbers in literals.items():
                    found.add_word(literal, numbers)
                found.make_automaton()

    def candidates(self, column: str, text: str) -> set[int]:
        out = set(self.always[column])
        if column in self.automata:
            for _, numbers in self.automata[column].iter(text):
                out.update(numbers)
        return out

    def first(self, texts: dict[str, str | None]) -> str | None:
        """The class of the rule whose match ends first (of equal ends the earlier rule)."""
        best = None
        for column in self.columns:
            text = texts[column]
            if text is not None:
                for no in self.candidates(column, text):
                    hit = self.rules[no][0].search(text)
                    if hit and (best is None or (hit.end(), no) < best):
                        best = hit.end(), no
        return None if best is None else self.rules[best[1]][1]


def classify_many(entries: DataFrame, exact: DataFrame | None, rounds: list[list[tuple[str, str, str]]],
                  word: str = "headword", other: str = "other") -> DataFrame:
    """X-13 for tables of hundreds of rules: what `classify` gives, for patterns that mean the same to Python.

    The rules are sent once per task; rows pass in Arrow batches, and nothing is shuffled but the words of `exact`.
    """
    columns = sorted({column for rules in rounds for _, _, column in rules})

    @F.pandas_udf("string")
    def chosen(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        tables = [RuleTable(rules) for rules in rounds]
        for batch in batches:
            out = []
            for values in zip(*((batch,) if isinstance(batch, pd.Series) else batch)):
                texts = dict(zip(columns, values))
                out.append(next((c for c in (t.first(texts) for t in tables) if c is not None), other))
            yield pd.Series(out, dtype=object)

    own = F.lit(None).cast("string")
    if exact is not None:
        entries = entries.join(exact.select(F.col("word").alias(word), F.col("class").alias("_own")), word, "left")
        own = F.col("_own")
    return entries.withColumn("class", F.coalesce(own, chosen(*columns))).drop("_own")


def group_small(classified: DataFrame, kept: list[str]) -> DataFrame:
    """X-14: classes that are not kept go to `rest`."""
    return classified.withColumn("class_group", F.when(F.col("class").isin(*kept), F.col("class")).otherwise("rest"))


# fixed value: must equal the original's pattern
LINK = r"^,?\s*(?:\$\$)?(?:(?:Ion)\. Noun,)?\s*\(([A-Za-z)(/=\\+|&']*?)(?:, cf\. .*?)?\)\s+"


def related_word(rest) -> Column:
    """X-15: word in parentheses at the start of the text, or nothing."""
    return F.regexp_extract(_col(rest), LINK, 1)


def start_variants(entries: DataFrame, core: str = "core", word: str = "headword",
                   either: str = r"^\S+ or ([^\s,]+),") -> DataFrame:
    """X-16: one row per headword of `A or B, ...` entries; without the comma the second word is no headword."""
    second = F.regexp_extract(core, either, 1)
    return entries.withColumn("start", F.explode(F.when(second != "", F.array(word, second)).otherwise(F.array(word))))


def stem_lengths(stem) -> Column:
    """X-17: lengths written in a stem: diphthong, h, w long; e, o short; a, i, u by the
    mark that follows (_ or = long, ^ short), else open."""
    t = F.regexp_replace(_col(stem), r"[aeou]i(?![=/]*\+)|[aoehw]u(?![=/]*\+)", "L")
    t = F.regexp_replace(t, r"[aiu][_=]|[hw]", "L")
    t = F.regexp_replace(t, r"[aiu]\^|[eo]", "S")
    return F.translate(F.regexp_replace(F.translate(t, "aiu", "QQQ"), "[^LSQ]", ""), "LSQ", "ls?")
