"""Normalisation of beta-code text (N-*). Everything here is one Column to one Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Character classes and repair patterns of the transliteration.
MARKS = r")(/=\\&+|'"
NON_BETA = r"[^A-Za-z)(/=\\+|'\s*]"
NON_BETA_RUN = r"[^A-Za-z)(/=\\+|'*]+"
LEADING_MARKS = r"^\s*([=/\\)(]+)([aehiowur])([^=/\\)(]|$)"
ACCENT_BEFORE_BREATHING = r"([=/\\])([)(])"
PAREN_BEFORE_LETTER = r"^\(([a-z])"
PAREN_AFTER_LETTER = r"([bcdfgjklmnpqrstvxyz][iu]|[a-z][abcdefghjklmnopqrstvwxyz])\("
SECOND_ACUTE = r"^([^/=]*[/=][^/=]*)/([^/=]*).*$"
# most tokens carry none of the faults: one test lets them through unchanged
ANY_FAULT = "|".join((LEADING_MARKS, ACCENT_BEFORE_BREATHING, PAREN_BEFORE_LETTER, PAREN_AFTER_LETTER))
RANGE_OR_DIGIT = r"\?|(\d+-(\d+|ff|fin).*?\n)|\d"
SPEAKER_LINE = r"\n\*\S*( *|( +(a|b|\*a|\*b)))\n"
TWO_ACCENT_WORD = "dia/doxa/"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Bind a value once: body(v) may use v many times without copying its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decapitalize(token) -> Column:
    """N-1: lower case; `*` + marks + letter becomes letter + marks."""
    low = F.lower(_col(token))
    moved = F.regexp_replace(low, rf"(?s)^\*([{MARKS}]+)(.)(.*)$", "$2$1$3")
    return F.when(low.rlike(rf"(?s)^\*[{MARKS}]+."), moved).otherwise(F.replace(low, F.lit("*"), F.lit("")))


def decapitalize_line(text) -> Column:
    """N-2: N-1 on every blank-separated token, as two passes over the whole line."""
    low = F.lower(_col(text))
    moved = F.regexp_replace(low, rf"(^| )\*([{MARKS}]+)([^ ])", "$1$3$2")
    return F.replace(moved, F.lit("*"), F.lit(""))


def beta_only(text) -> Column:
    """N-3: everything that is not beta code becomes a blank."""
    return F.regexp_replace(_col(text), NON_BETA, " ")


def squeeze(text) -> Column:
    """N-4: runs of white space become one blank, none at the ends."""
    one = F.regexp_replace(_col(text), r"\s+", " ")
    return F.regexp_replace(one, r"^\s+|\s+$", "")


def newline_to_blank(text) -> Column:
    return F.replace(_col(text), F.lit("\n"), F.lit(" "))


def clean_line(text) -> Column:
    """N-5: the line cleaner; the result ends in one blank (the last word boundary)."""
    # blanking (N-3) and squeezing (N-4) in one pass: any run of other characters is a blank
    fixed = F.regexp_replace(F.replace(_col(text), F.lit("(??)"), F.lit("a(")), NON_BETA_RUN, " ")
    return F.concat(F.trim(fixed), F.lit(" "))


def clean_verse(text) -> Column:
    """N-2 then N-5: what the scanner reads."""
    return clean_line(decapitalize_line(text))


def block_text(text) -> Column:
    """N-6 up to the hyphens: ranges, digits, speaker names gone; a dash stands apart."""
    c = F.regexp_replace(_col(text), RANGE_OR_DIGIT, "")
    c = F.regexp_replace(c, SPEAKER_LINE, "\n")
    return F.replace(c, F.lit("--"), F.lit(" --"))


def block_words(text) -> Column:
    """The rest of N-6: beta code in single blanks."""
    return F.trim(F.regexp_replace(_col(text), NON_BETA_RUN, " "))


def clean_block(text) -> Column:
    """N-6: block cleaner: ranges, digits, speaker names, wrapped words."""
    return block_words(F.regexp_replace(block_text(text), r"- *\n", ""))


def repair_accents(token) -> Column:
    """N-7: each test reads the token as given; the replacements chain."""
    def fix(raw, now, pattern, to):
        return let(now, lambda s: F.when(raw.rlike(pattern), F.regexp_replace(s, pattern, to)).otherwise(s))

    def chain(raw):
        out = F.regexp_replace(raw, LEADING_MARKS, "$2$1$3")
        out = fix(raw, out, ACCENT_BEFORE_BREATHING, "$2$1")
        out = fix(raw, out, PAREN_BEFORE_LETTER, "$1")
        return fix(raw, out, PAREN_AFTER_LETTER, "$1")

    return let(_col(token), lambda t: F.when(t.rlike(ANY_FAULT), chain(t)).otherwise(t))


def drop_second_acute(token) -> Column:
    """The second accent of a word goes if it is acute (added before an enclitic)."""
    return let(_col(token), lambda t: F.when(t == TWO_ACCENT_WORD, t).otherwise(
        F.regexp_replace(t, SECOND_ACUTE, "$1$2")))


def standardize(token) -> Column:
    """N-8: the lookup key of a token."""
    return F.replace(drop_second_acute(repair_accents(decapitalize(token))), F.lit("\\"), F.lit("/"))


def standardized(df: DataFrame, raw: str = "raw", out: str = "token") -> DataFrame:
    """N-8 as a new column of a table, in two steps that stay apart: each is computed once and compiled, unlike a bound value inside one expression."""
    df = df.withColumn("_low", decapitalize(raw))
    low = F.col("_low")
    now = F.regexp_replace(low, LEADING_MARKS, "$2$1$3")
    for pattern, to in ((ACCENT_BEFORE_BREATHING, "$2$1"), (PAREN_BEFORE_LETTER, "$1"), (PAREN_AFTER_LETTER, "$1")):
        now = F.when(low.rlike(pattern), F.regexp_replace(now, pattern, to)).otherwise(now)
    df = df.withColumn("_whole", F.when(low.rlike(ANY_FAULT), now).otherwise(low))
    whole = F.col("_whole")
    one = F.when(whole == TWO_ACCENT_WORD, whole).otherwise(F.regexp_replace(whole, SECOND_ACUTE, "$1$2"))
    return df.withColumn(out, F.replace(one, F.lit("\\"), F.lit("/"))).drop("_low", "_whole")


def strip_diacritics(token) -> Column:
    """N-9: letters only, no marks and no digits."""
    return F.translate(_col(token), ")(/=\\&+|'0123456789", "")


def strip_digits(token) -> Column:
    return F.translate(_col(token), "0123456789", "")
