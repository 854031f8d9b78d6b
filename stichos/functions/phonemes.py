"""Sounds, nuclei and syllables of a line, as string and array expressions (S-1, S-5 ... S-8).

A line reaches this module as a *sound text*: beta code in which a blank is a word
boundary and a dot joins a clitic to its host. Three extra marks may follow a letter:
`_` long and `^` short for a vowel whose inherent length is known, and `^` after z for a
z that may count as a single consonant. `~` after s stands for sk as one consonant.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stichos.functions.text import _col

# The sound inventory.
DIPHTHONG = "[aeou]i|[aoehw]u"
SOUND = rf"(?:{DIPHTHONG}|[a-z])[^a-z. ]*| "
DOUBLE_CONSONANTS = "zcy"
MUTES = "pbfkgxtdq"
LIQUIDS_RL = "rl"
LIQUIDS_MN = "mn"
# Vowel pairs that may run together: (first, second, what must follow).
SYNIZESIS = {
    0: (),
    2: (("e", "w", "end"), ("e", "w", "n")),
    5: (("e", "w", "end"), ("e", "w", "n"), ("e", "oi", "end"), ("e", "a", "end"), ("e", "a", "s")),
}
SYNIZESIS_OF_PASS = {1: 0, 2: 2, 3: 0, 4: 2, 5: 5}

STUDENT = "student"
NATIVE = "native"


def split_diaeresis(sound_text) -> Column:
    """A vowel with + starts its own sound."""
    return F.regexp_replace(_col(sound_text), r"([aeiouhwj])\+", r".$1")


def drop_loose_marks(sound_text) -> Column:
    """Marks at the start of a word belong to no sound."""
    return F.regexp_replace(_col(sound_text), r"(^|[ .])[^a-z .]+", "$1")


def sounds(sound_text) -> Column:
    """S-1 on a whole line: array of sounds, a blank for a word boundary."""
    return F.regexp_extract_all(split_diaeresis(drop_loose_marks(sound_text)), F.lit(SOUND), 0)


def merge_vowels(text: Column, level: int) -> Column:
    """S-8: run e + w (for level 5 also e + oi, e + a) together into the nucleus Y.

    The pairs never overlap, so all are one substitution on the text. What must follow
    the second vowel also keeps it from being the first half of a diphthong.
    """
    if level == 0:
        return text
    ways = []
    for first, second, follow in SYNIZESIS[level]:
        if follow == "end":
            ahead = "(?= )"
        else:
            # the consonant itself or one closing consonant before it, with another nucleus
            # to come; or the consonant alone at the end of the line
            mid = rf"(?:[bgdzqklmncprstfxy][^a-z. ]*[. ]*)?{follow}(?![^a-z. ])[^aeiouhwj]*[aeiouhwj]"
            ahead = rf"(?=\.?(?:{mid}|{follow}[. ]*$))"
        ways.append(rf"{first}[^a-z. ]*\.?{second}[^a-z. ]*{ahead}")
    return F.regexp_replace(text, "|".join(ways), "Y")


def merged_text(sound_text, level: int) -> Column:
    """The sounds of the line as text, vowels run together; a mark that stands alone is no sound, so it hides none from the look-ahead."""
    return merge_vowels(split_diaeresis(drop_loose_marks(sound_text) if level else sound_text), level)


def skeleton(merged, approach: str) -> Column:
    """Reduce the text of merged_text to nuclei, consonants and word ends.

    Nuclei: A long by nature, E short by nature, I open; Y run together (S-8). With the
    native approach a diphthong without a known long value is D (open) or B (short).
    """
    t = F.translate(_col(merged), ")(/\\|'&*+", "")
    if approach == NATIVE:
        t = F.regexp_replace(t, rf"(?:{DIPHTHONG})\^*[_=][_=^]*", "A")
        t = F.regexp_replace(t, rf"(?:{DIPHTHONG})\^+", "B")
        t = F.regexp_replace(t, rf"(?:{DIPHTHONG})", "D")
        t = F.regexp_replace(t, r"[hw][_=^]*|[aeiouj]\^*[_=][_=^]*", "A")
        t = F.regexp_replace(t, r"[aiuj]\^+|[eo]\^*", "E")
    else:
        t = F.regexp_replace(t, rf"(?:{DIPHTHONG}|[hw])[_=^]*|[aeiouj]\^*[_=][_=^]*", "A")
    return F.translate(t, "eoaiuj._=~", "EEIIII")


def nuclei_count(skel) -> Column:
    return F.length(F.translate(_col(skel), " ^bgdzqklmncprstfxyv", ""))


# One letter per consonant class: p mute, r and n liquids, z double, v digamma, s the rest.
_CLASS_FROM = MUTES + LIQUIDS_RL + LIQUIDS_MN + DOUBLE_CONSONANTS + " "
_CLASS_TO = "p" * len(MUTES) + "rrnn" + "zzz"
NUCLEI = "AEIYBD"
KINDS = "oxz4689<vprns"


def cv_pattern(skel) -> Column:
    """S-5 and S-6: every syllable as nucleus, `|` if a word ends before the next nucleus,
    and one letter for the consonants up to there.

    o none, x closed, z one double consonant, 4 mute + r/l, 6 mute + m/n, 8 two with a
    digamma (9 if the other is a double one), < one short z, v one digamma, other letters one open consonant.
    """
    t = F.regexp_replace(_col(skel), r"^[^A-Z]+", "")
    t = F.regexp_replace(t, r"([A-Z])(?=[a-z^]* )", "$1|")
    t = F.replace(F.translate(F.replace(t, F.lit("z^"), F.lit("<")), _CLASS_FROM, _CLASS_TO), F.lit("^"), F.lit(""))
    t = F.replace(F.replace(F.replace(t, F.lit("pr"), F.lit("4")), F.lit("pn"), F.lit("6")), F.lit("zv"), F.lit("9"))
    t = F.regexp_replace(t, r"(?<=[A-Z|])(?:v[a-z]|[a-z]v)(?=[A-Z])", "8")
    t = F.regexp_replace(t, r"(?<=[A-Z|])(?:[a-z469<]{2,}|[a-z9<]$)", "x")
    return F.regexp_replace(t, r"([A-Z]\|?)(?=[A-Z]|$)", "$1o")


def _digits(pattern: Column, digits: dict[str, str], among: str, dropped: str) -> Column:
    to = "".join(next((d for d, letters in digits.items() if c in letters), "0") for c in among)
    return _octal(F.translate(pattern, among + dropped, to))


def _octal(digits: Column) -> Column:
    # twenty digits fit a long; lines with more syllables never scan
    return F.conv(F.right(digits, F.lit(20)), 8, 10).cast("long")


# A set of syllables is a long with one octal digit per syllable (the last syllable is the
# last digit), so one number read from the pattern carries up to three sets.
LANE = int("1" * 21, 8)


def both(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def either(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def without(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def _lane(packed, k: int) -> Column:
    return both(F.shiftright(_col(packed), k) if k else _col(packed), F.lit(LANE))


def packed_sets(pattern, approach: str) -> dict[str, Column]:
    """The facts of a line as octal numbers; see syllable_sets for the reading."""
    t = _col(pattern)
    pause = F.replace(F.translate(t, NUCLEI + "|" + KINDS, "0" * len(NUCLEI) + "1"), F.lit("01"), F.lit("1"))
    shorten = "AYDB" if approach == NATIVE else "AY"
    return {
        "n": F.length(F.translate(t, KINDS + "|", "")),
        "nature": _digits(t, {"1": "A", "2": "EB", "4": "Y"}, NUCLEI, KINDS + "|"),
        "shorten": _digits(t, {"1": shorten}, NUCLEI, KINDS + "|"),
        "pause": _octal(pause),
        "kind": _digits(t, {"1": "o", "2": "xz469", "4": "v"}, KINDS, NUCLEI + "|"),
        "pairs": _digits(t, {"1": "4", "2": "6", "4": "89"}, KINDS, NUCLEI + "|"),
        "short_z": _digits(t, {"1": "<"}, KINDS, NUCLEI + "|")}


SET_NAMES = ("n", "long", "short", "pause", "corr", "ml_rl", "ml_mn", "dig_c", "dig_h")


def syllable_sets(p: dict[str, Column]) -> dict[str, Column]:
    """S-7: length classes as sets.

    long, short (the rest is open), pause = a word ends, corr = correption possible,
    ml_rl / ml_mn = mute + liquid follows, dig_c = closed by a digamma only, dig_h =
    hiatus by a digamma.
    """
    bare, closed, one_v = (_lane(p["kind"], k) for k in range(3))
    long_nature, short_nature, merged = (_lane(p["nature"], k) for k in range(3))
    rl, mn, doublet = (_lane(p["pairs"], k) for k in range(3))
    hiatus = both(one_v, p["pause"])
    open_next = either(hiatus, both(without(bare, F.lit(1)), p["pause"]))
    return {
        "n": p["n"],
        "long": either(closed, without(either(long_nature, merged), open_next)),
        "short": without(without(short_nature, closed), either(doublet, p["short_z"])),
        "pause": p["pause"], "corr": both(open_next, p["shorten"]),
        "ml_rl": without(rl, merged), "ml_mn": without(mn, merged),
        "dig_c": without(doublet, merged), "dig_h": without(hiatus, merged)}


def class_string(n, long, short) -> Column:
    """Length classes for people: L long, S short, U open (one letter per syllable of a scanned line)."""
    digits = F.conv((_col(long) + 2 * _col(short)).cast("string"), 10, 8)
    return F.translate(F.lpad(digits, _col(n), F.lit("0")), "012", "ULS")


def syllable_facts(pattern, approach: str) -> dict[str, Column]:
    """S-5 to S-7 for lines of any length: the facts of syllable_sets, read from cv_pattern as text.

    classes has one letter per syllable, the others count syllables. Every step reads the whole line once; the pattern is read
    many times, so it should be a column that is computed once.
    """
    t = _col(pattern)
    opened = r"(?:\|v|\|o(?!$))"
    shorten = "AYDB" if approach == NATIVE else "AY"
    whole = NUCLEI.replace("Y", "")
    classes = F.regexp_replace(t, rf"[{NUCLEI}]\|?[xz469]", "l")
    classes = F.regexp_replace(classes, rf"[AY]{opened}", "u")
    classes = F.regexp_replace(classes, rf"[AY]\|?[{KINDS}]", "l")
    classes = F.regexp_replace(classes, r"[EB]\|?[ovprns]", "s")
    classes = F.regexp_replace(classes, rf"[{NUCLEI}]\|?[{KINDS}]", "u")
    count = lambda test: F.regexp_count(t, F.lit(test))
    return {"n": F.length(classes), "classes": F.upper(classes), "pauses": F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit(""))),
            "corr": count(rf"[{shorten}]{opened}"), "ml": count(rf"[{whole}]\|?[46]"),
            "dig_c": count(rf"[{whole}]\|?[89]"), "dig_h": count(rf"[{whole}]\|v")}


# ---- lengths of a word's vowels without a dictionary -------------------------------------

def default_lengths(word) -> Column:
    """X-20: one of l, s, ? per vowel: diphthongs, h and w long, e and o short."""
    t = split_diaeresis(_col(word))
    t = F.regexp_replace(t, rf"{DIPHTHONG}|[hw]", "L")
    t = F.translate(t, "eoaiu", "SSQQQ")
    return F.translate(F.regexp_replace(t, "[^LSQ]", ""), "LSQ", "ls?")


def only_known_vowels(word) -> Column:
    """X-21: no a, i, u outside a diphthong."""
    plain = F.regexp_replace(_col(word), r"[aeou]i(?![=/]*\+)|[aoehw]u(?![=/]*\+)", "1")
    return ~plain.rlike("[aiu]")


def tag_lengths(word, lengths) -> Column:
    """S-2: write the length of each vowel behind it (_ long, ^ short, nothing if open).

    Vowel k is found by its position among the sounds that hold a vowel.
    """
    parts = F.regexp_extract_all(split_diaeresis(_col(word)), F.lit(rf"(?:{DIPHTHONG}|[a-z])[^a-z]*|^[^a-z]+"), 0)

    def add(acc, sound):
        k = acc["k"] + 1
        mark = F.translate(F.substr(_col(lengths), k, F.lit(1)), "ls?", "_^")
        head = F.regexp_extract(sound, rf"^(?:{DIPHTHONG}|[a-z])", 0)
        tagged = F.concat(acc["out"], F.lit("."), head, mark, F.substr(sound, F.length(head) + 1))
        vowel = sound.rlike("^[aeiouhw]")
        return F.struct(F.when(vowel, k).otherwise(acc["k"]).alias("k"),
                        F.when(vowel, tagged).otherwise(F.concat(acc["out"], F.lit("."), sound)).alias("out"))

    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    return F.regexp_replace(F.aggregate(parts, start, add)["out"], r"\.+", ".")
