"""The scan of whole batches of lines as arrays of numbers (S-5 ... S-10, S-12).

The same steps as the column expressions of `phonemes` and `feet`, for lines in the plain alphabet (small letters, marks, blanks and dots): the
bytes of a batch are one array, a step is a few operations on all of its letters. Lines with other characters are left to the expressions.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from stichos.functions.feet import LEVEL_OF_PASS, MAX_SYLLABLES, MIN_SYLLABLES
from stichos.functions.phonemes import DOUBLE_CONSONANTS, LANE, LIQUIDS_MN, LIQUIDS_RL, MUTES, NATIVE, SET_NAMES, SYNIZESIS, SYNIZESIS_OF_PASS

cloudpickle.register_pickle_by_value(sys.modules[__name__])           # executors need not have the package: its values go with the functions

VOWELS, CONSONANTS = "aeiouhwj", "bgdzqklmncprstfxyv"
DROPPED = ")(/\\|'&*+"
END = 10
# symbols of consonant classes: mute, r or l, m or n, double, digamma, s, short z
P, R, N, Z, V, S, SHORT_Z = 1, 2, 3, 4, 5, 6, 7
# nuclei: long, short, open; run together; diphthongs without a known long value, open or short
A, E, I, Y, D, B = 1, 2, 3, 4, 5, 6


def _among(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_VOWEL, _CONSONANT, _PLACED = _among(VOWELS), _among(CONSONANTS), _among(VOWELS + CONSONANTS + " .\n")
_MARK, _KNOWN = _among(DROPPED + "=_^~"), _among(VOWELS + CONSONANTS + DROPPED + "=_^~ .")
_BEFORE_FOLLOW = _among("bgdzqklmncprstfxy")
_BEFORE_I, _BEFORE_U, _SHORT_OR_OPEN, _ALWAYS_SHORT, _ALWAYS_LONG = _among("aeou"), _among("aoehw"), _among("aeiouj"), _among("eo"), _among("hw")
_SYMBOL = np.zeros(256, np.uint8)
for _c in CONSONANTS:
    _SYMBOL[ord(_c)] = next((v for v, of in ((P, MUTES), (R, LIQUIDS_RL), (N, LIQUIDS_MN), (Z, DOUBLE_CONSONANTS), (V, "v")) if _c in of), S)
_FEET = ["".join("DS"[(k >> (4 - i)) & 1] for i in range(5)) + "F" for k in range(32)] + [None]
_ASKED = np.array([int(f.replace("D", "100").replace("S", "11").replace("F", "10"), 8) for f in _FEET[:32]] + [0], np.int64)
_LANE = np.int64(LANE)


def scanner(approach: str, passes: tuple[int, ...]):
    """A function from an Arrow array of texts to an array of structs: known (the line is in the plain alphabet), scan_pass, feet, ambiguous, the sets, long."""
    native = approach == NATIVE

    def scan(texts: pa.Array) -> pa.Array:
        size = len(texts)
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        joined = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.large_binary()), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        found, known = read_lines(joined, native, passes)
        none = found["feet"] < 0
        good = ~none
        index = pa.array(np.where(none, 0, found["feet"]).astype(np.int32), mask=none)
        feet = pa.DictionaryArray.from_arrays(index, pa.array(_FEET[:32])).cast(pa.string())
        fields = [pa.array(known), pa.array(found["scan_pass"], mask=found["scan_pass"] == 0), feet, pa.array(found["ambiguous"])]
        fields += [pa.array(found[c].astype(np.int32) if c == "n" else found[c], mask=none) for c in SET_NAMES]
        fields.append(pa.array(found["resolved"], mask=none))
        assert len(good) == size
        return pa.StructArray.from_arrays(fields, names=["known", "scan_pass", "feet", "ambiguous", *SET_NAMES, "resolved"])

    return scan


def scan_type() -> str:
    sets = ", ".join(f"{c} {'int' if c == 'n' else 'bigint'}" for c in SET_NAMES)
    return f"known boolean, scan_pass int, feet string, ambiguous boolean, {sets}, resolved bigint"


def read_lines(joined: pa.Array, native: bool, passes: tuple[int, ...]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """What scan_lines finds for lines that each end in a line feed; and which of them are in the plain alphabet."""
    lines = len(joined)
    found = {c: np.zeros(lines, np.int64) for c in (*SET_NAMES, "resolved")}
    found |= {"scan_pass": np.zeros(lines, np.int32), "feet": np.full(lines, -1, np.int64), "ambiguous": np.zeros(lines, bool)}
    if not lines:
        return found, np.zeros(0, bool)
    ends = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + lines + 1]
    text = np.frombuffer(joined.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    ends = ends[1:] - ends[0] - 1
    known = np.ones(lines, bool)
    strange = ~_KNOWN[text]
    strange[ends] = False
    if strange.any():
        known[np.searchsorted(ends, np.flatnonzero(strange))] = False
        text = np.where(strange, np.uint8(32), text)                  # a line feed within a line ends none
    word = _words(text, ends, known)
    nuclei = {0: _nuclei(word, native)}
    for level in {SYNIZESIS_OF_PASS[p] for p in passes} - {0}:
        nuclei[level] = _merged(word, nuclei[0], level)
    count = {level: np.bincount(word["line"][at], minlength=lines) for level, (at, _) in nuclei.items()}
    most = max(SYNIZESIS_OF_PASS[p] for p in passes)
    is_open = known & (count[0] >= MIN_SYLLABLES) & ((count[0] <= MAX_SYLLABLES) | (count[most] <= MAX_SYLLABLES))
    sets: dict[int, tuple] = {}
    for p in passes:
        level, relax = SYNIZESIS_OF_PASS[p], LEVEL_OF_PASS[p]
        if level not in sets:
            rows = np.flatnonzero(is_open & (count[level] >= MIN_SYLLABLES) & (count[level] <= MAX_SYLLABLES))
            of = _sets(word, *nuclei[level], rows, count[level], native)
            sets[level] = rows, of, _starts(of)
        rows, of, at = sets[level]
        first = np.int64(1) << (3 * (of["n"] - 1))
        ok = at["f2"] if relax == 2 else at["f0"]
        for _ in range(5):
            ok = (at[f"d{relax}"] & (ok << 9)) | (at["s2" if relax == 2 else "s0"] & (ok << 6))
        hit = is_open[rows] & ((ok & first) != 0)
        here = rows[hit]
        feet, twice = _feet({k: v[hit] for k, v in at.items()}, first[hit], relax)
        found["scan_pass"][here], found["ambiguous"][here] = p, twice
        found["feet"][here] = np.where(twice, -1, feet)
        for c in SET_NAMES:
            found[c][here] = of[c][hit]
        found["resolved"][here] = _ASKED[feet] | (1 & ~of["short"][hit])
        is_open[here] = False
    return found, known


def _words(text: np.ndarray, ends: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """Letters, blanks, dots and line ends in their order, with what the marks behind each say."""
    placed = _PLACED[text]
    places = np.flatnonzero(placed)
    at = np.cumsum(placed, dtype=np.int32) - 1

    def behind(marks: str) -> np.ndarray:
        out = np.zeros(len(places) + 1, bool)                         # the last is for marks before the first letter
        where = np.zeros(len(text), bool)
        for m in marks:
            where |= text == ord(m)
        out[at[where]] = True
        return out[:-1]

    char = text[places]
    vowel, consonant = _VOWEL[char], _CONSONANT[char]
    after = text[np.minimum(places + 1, len(text) - 1)]
    apart = vowel & (after == ord("+"))
    line = np.cumsum(char == END, dtype=np.int32)
    line -= char == END
    gap = np.diff(places, append=places[-1] + 1) - 1
    word = {"char": char, "vowel": vowel, "apart": apart, "line": line, "marked": gap > apart, "drawn": behind("=_"),
            "caret": behind("^") if (text == ord("^")).any() else np.zeros(len(places), bool),
            "consonants": np.cumsum(consonant, dtype=np.int32), "blanks": np.cumsum(char == 32, dtype=np.int32), "ends": np.flatnonzero(char == END)}
    # carets that stand alone, and sk marks elsewhere than behind s, are left to the expressions
    odd = word["caret"] & ~(vowel | consonant)
    if (text == ord("~")).any():
        tilde = np.flatnonzero(text == ord("~"))
        known[np.searchsorted(ends, tilde[(tilde == 0) | (text[tilde - 1] != ord("s"))])] = False
    if odd.any():
        # marks before the first letter of a line count for the end of the line before
        known[np.minimum(line[odd] + (char[odd] == END), len(ends) - 1)] = False
    if (text[:places[0]] == ord("^")).any():
        known[0] = False
    symbol = _SYMBOL[char[consonant]]
    symbol[(char[consonant] == ord("z")) & word["caret"][consonant]] = SHORT_Z
    word["symbol"] = np.concatenate([symbol, np.zeros(2, np.uint8)])
    return word


def _nuclei(word: dict[str, np.ndarray], native: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nuclei with none run together, and their kinds."""
    char, vowel = word["char"], word["vowel"]
    following = np.append(char[1:], END)
    touches = ~(word["drawn"] | word["caret"]) & ~np.append(word["apart"][1:], False)
    pair = ((_BEFORE_I[char] & (following == ord("i"))) | (_BEFORE_U[char] & (following == ord("u")))) & touches
    # of two pairs that share a vowel the first is one sound; with a dictionary's lengths the one that carries a length
    chained = np.append(False, pair[:-1]) & pair
    if native and chained.any():
        second = chained & (np.append((word["drawn"] | word["caret"])[1:], False))
        pair &= ~(chained & ~second)
        pair &= ~np.append(second[1:], False)
    else:
        pair &= ~chained
    is_nucleus = vowel & ~np.append(False, pair[:-1])
    at = np.flatnonzero(is_nucleus)
    c, double = char[at], pair[at]
    last = at + double
    drawn, caret = word["drawn"][last], word["caret"][last]
    kind = np.where(_ALWAYS_SHORT[c] & ~drawn, E, I)
    kind[_ALWAYS_LONG[c] | (_SHORT_OR_OPEN[c] & drawn)] = A
    if native:
        kind[~drawn & caret & (kind == I)] = E
        kind = np.where(double, np.where(drawn, A, np.where(caret, B, D)), kind)
    else:
        kind[double] = A
    return at, kind.astype(np.uint8)


def _merged(word: dict[str, np.ndarray], plain: tuple[np.ndarray, np.ndarray], level: int) -> tuple[np.ndarray, np.ndarray]:
    """The nuclei with vowels run together (S-8)."""
    char, apart, marked, line, ends = word["char"], word["apart"], word["marked"], word["line"], word["ends"]
    size = len(char)
    padded = np.concatenate([char, np.full(4, END, np.uint8)])
    seconds = {second for _, second, _ in SYNIZESIS[level]}
    assert {first for first, _, _ in SYNIZESIS[level]} == {"e"}
    e = np.flatnonzero(char == ord("e"))
    dot = padded[e + 1] == ord(".")
    k = e + 1 + dot
    maybe = np.isin(padded[k], [ord(s[0]) for s in seconds])
    e, dot, k = e[maybe], dot[maybe], k[maybe]
    fine = ~(dot & apart[k])
    e, k = e[fine], k[fine]
    is_letter = word["vowel"] | _CONSONANT[char]
    letters = np.flatnonzero(is_letter)
    letter_no = np.cumsum(is_letter, dtype=np.int32)                 # letters up to and with a place: the next letter's number
    letters = np.append(letters, size - 1)
    last_vowel = np.full(len(ends), -1)
    vowels = np.flatnonzero(word["vowel"])
    last_vowel[line[vowels]] = vowels
    last_letter = np.full(len(ends), -1)
    last_letter[line[letters[:-1]]] = letters[:-1]

    def follows(k: np.ndarray, follow: str) -> np.ndarray:
        m = k + 1
        m = m + (padded[m] == ord("."))
        m = np.minimum(m, size - 1)
        sound, own = ord(follow), line[m]
        alone = (char[m] == sound) & ~marked[m]
        direct = alone & ((last_vowel[own] > m) | (last_letter[own] == m))
        after = letters[np.minimum(letter_no[m], len(letters) - 1)]
        closed = _BEFORE_FOLLOW[char[m]] & (line[after] == own) & (after > m) & (char[after] == sound) & ~marked[after] & (last_vowel[own] > after)
        return direct | closed

    runs, gone = np.zeros(size, bool), np.zeros(size, bool)
    for _, second, follow in SYNIZESIS[level]:
        here = padded[k] == ord(second[0])
        if len(second) == 2:
            here &= (padded[k + 1] == ord(second[1]))
            here[here] &= ~marked[k[here]] & ~apart[k[here] + 1]
        tail = k + len(second) - 1
        if follow == "end":
            here &= padded[tail + 1] == 32
        else:
            here[here] &= follows(tail[here], follow)
        runs[e[here]] = True
        gone[k[here]] = True
        gone[tail[here]] = True
    at, kind = plain
    stays = ~gone[at]
    at, kind = at[stays], kind[stays].copy()
    kind[runs[at]] = Y
    return at, kind


def _sets(word: dict[str, np.ndarray], at: np.ndarray, kind: np.ndarray, rows: np.ndarray, count: np.ndarray, native: bool) -> dict[str, np.ndarray]:
    """phonemes.cv_pattern, packed_sets and syllable_sets for some of the lines."""
    if not len(rows):
        return {c: np.zeros(0, np.int64) for c in SET_NAMES}
    chosen = np.zeros(len(word["ends"]), bool)
    chosen[rows] = True
    line = word["line"][at]
    stop = np.append(at[1:], 0)                                      # the next nucleus, or the end of the line
    final = np.append(line[1:] != line[:-1], True)
    stop[final] = word["ends"][line[final]]
    mine = chosen[line]
    at, kind, stop, final = at[mine], kind[mine], stop[mine], final[mine]
    before = word["consonants"][at]
    several = word["consonants"][stop] - before
    pause = word["blanks"][stop] > word["blanks"][at]
    c1 = np.where(several > 0, word["symbol"][before], 0)
    c2 = np.where(several > 1, word["symbol"][before + 1], 0)
    two = several == 2
    rl, mn, zv = two & (c1 == P) & (c2 == R), two & (c1 == P) & (c2 == N), two & (c1 == Z) & (c2 == V)
    single = (several == 1) | zv                                     # one sign of the pattern; 4 and 6 besides
    eight = two & ~zv & ~final & ((c1 == V) | (c2 == V)) & (c1 != SHORT_Z) & (c2 != SHORT_Z)
    closed = ((several >= 2) & ~zv & ~eight) | (single & final) | zv | ((several == 1) & (c1 == Z))
    one_v = (several == 1) & (c1 == V) & ~final
    doublet = eight | (zv & ~final)
    short_z = (several == 1) & (c1 == SHORT_Z) & ~final
    shorten = (kind == A) | (kind == Y) | (native & ((kind == D) | (kind == B)))
    n = count[rows].astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    place = 3 * (np.repeat(starts + n - 1, n) - np.arange(len(at)))  # the last syllable is the last digit

    def packed(*bits: np.ndarray) -> np.ndarray:
        digits = np.zeros(len(at), np.int64)
        for k, b in enumerate(bits):
            digits |= b.astype(np.int64) << k
        return np.add.reduceat(digits << place, starts)

    def lanes(*bits: np.ndarray) -> list[np.ndarray]:
        whole = packed(*bits)
        return [(whole >> k) & _LANE for k in range(len(bits))]

    long_nature, short_nature, merged = lanes(kind == A, (kind == E) | (kind == B), kind == Y)
    bare, closed, one_v = lanes(several == 0, closed, one_v)
    rl, mn, doublet = lanes(rl, mn, doublet)
    shorten, pause, short_z = lanes(shorten, pause, short_z)
    hiatus = one_v & pause
    open_next = hiatus | (bare & ~np.int64(1) & pause)
    return {"n": n, "long": closed | ((long_nature | merged) & ~open_next), "short": short_nature & ~closed & ~(doublet | short_z),
            "pause": pause, "corr": open_next & shorten, "ml_rl": rl & ~merged, "ml_mn": mn & ~merged,
            "dig_c": doublet & ~merged, "dig_h": hiatus & ~merged}


def _starts(b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """feet.weights and feet.foot_starts."""
    every = _LANE & ~(np.int64(-1) << (3 * b["n"]))
    heavy, light = every & ~b["short"], every & ~b["long"]
    loose = light | (b["long"] & (b["ml_rl"] | b["ml_mn"]))
    ictus = heavy | (b["short"] & b["pause"])
    two_light, two_loose, next_heavy, last_but_one = (light << 3) & (light << 6), (loose << 3) & (loose << 6), heavy << 3, np.int64(8)
    return {"d0": heavy & two_light, "d1": heavy & two_loose, "d2": ictus & two_loose, "s0": heavy & next_heavy, "s2": ictus & next_heavy,
            "f0": heavy & last_but_one, "f2": ictus & last_but_one}


def _feet(p: dict[str, np.ndarray], here: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """feet.feet_of: the five feet as bits (1 for a spondee), and whether there are several readings."""
    ok, at = p["f2"] if level >= 2 else p["f0"], []
    for _ in range(5):
        after_d, after_s = ok << 9, ok << 6
        d, s = p["d0"] & after_d, p["s0"] & after_s
        if level >= 1:
            d = d | (p["d1"] & after_d & ~(d | s))
        if level >= 2:
            d, s = d | (p["d2"] & after_d & ~(d | s)), s | (p["s2"] & after_s & ~(d | s))
        at.append((d, s))
        ok = d | s
    feet, twice = np.zeros(len(here), np.int64), np.zeros(len(here), bool)
    for d, s in reversed(at):
        is_d = (d & here) != 0
        twice |= is_d & ((s & here) != 0)
        here = np.where(is_d, here >> 9, here >> 6)
        feet = 2 * feet + ~is_d
    return feet, twice
