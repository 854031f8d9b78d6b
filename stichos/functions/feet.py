"""Foot search over the syllable sets of a line (S-9), parallel over all start positions.

A line holds at most 17 syllables, so a long holds one octal digit per syllable. Shifting
and masking whole sets replaces the search from each start: after foot f the set `ok`
holds every syllable at which feet f ... 6 can be read to the end of the line.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stichos.functions.phonemes import LANE, both, either, without
from stichos.functions.text import _col, let

MIN_SYLLABLES, MAX_SYLLABLES = 12, 17
AMBIGUOUS = "?"
# How far each pass may relax: 1 a long before mute + liquid may stand for a short,
# 2 also the first place of a foot may be a short at word end (ictus).
LEVEL_OF_PASS = {1: 0, 2: 1, 3: 2, 4: 2, 5: 2}


def _up(bits: Column, syllables: int) -> Column:
    return F.shiftleft(bits, 3 * syllables)


def first_digit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), 3 * (n - 1))


def weights(b: dict[str, Column]) -> dict[str, Column]:
    """Which syllables may stand in a heavy or light place, strictly and relaxed."""
    every = without(F.lit(LANE), F.call_function("shiftleft", F.lit(-1).cast("long"), 3 * b["n"]))
    heavy, light = without(every, b["short"]), without(every, b["long"])
    return {"heavy": heavy, "light": light,
            "loose": either(light, both(b["long"], either(b["ml_rl"], b["ml_mn"]))),
            "ictus": either(heavy, both(b["short"], b["pause"]))}


def foot_starts(w: dict[str, Column]) -> dict[str, Column]:
    """Where a dactyl (d) or spondee (s) may start, per level, and the last foot (f)."""
    two_light = both(_up(w["light"], 1), _up(w["light"], 2))
    two_loose = both(_up(w["loose"], 1), _up(w["loose"], 2))
    next_heavy, last_but_one = _up(w["heavy"], 1), F.lit(8).cast("long")
    return {"d0": both(w["heavy"], two_light), "d1": both(w["heavy"], two_loose), "d2": both(w["ictus"], two_loose),
            "s0": both(w["heavy"], next_heavy), "s2": both(w["ictus"], next_heavy),
            "f0": both(w["heavy"], last_but_one), "f2": both(w["ictus"], last_but_one)}


def readable(p: dict[str, Column], level: int, upto: Column | None, feet: int) -> Column:
    """One or more steps of the test whether a line can be read when everything up to
    `level` is allowed: the starts of feet from which the line can be read to its end.

    Relaxing foot by foot finds a reading exactly when relaxing everywhere does, so this
    test needs no levels: each foot is one shift-and-mask step.
    """
    d, s = p[f"d{level}"], p["s2"] if level == 2 else p["s0"]
    ok = (p["f2"] if level == 2 else p["f0"]) if upto is None else upto
    for _ in range(feet):
        ok = either(both(d, _up(ok, 3)), both(s, _up(ok, 2)))
    return ok


def feet_of(p: dict[str, Column], n: Column, level: Column) -> Column:
    """The feet as six letters D, S, F, or `?` if there are several readings.

    A higher level is tried at a foot and a start only where no lower one leads anywhere,
    without regard to what stands before. Call it where the line is known to be readable.
    """
    nothing = F.lit(0).cast("long")
    d1 = F.when(level >= 1, p["d1"]).otherwise(nothing)
    d2 = F.when(level >= 2, p["d2"]).otherwise(nothing)
    s2 = F.when(level >= 2, p["s2"]).otherwise(nothing)
    final = F.when(level >= 2, p["f2"]).otherwise(p["f0"])

    def foot(acc, _):
        after_d, after_s = _up(acc["ok"], 3), _up(acc["ok"], 2)
        strict = F.struct(both(p["d0"], after_d).alias("d"), both(p["s0"], after_s).alias("s"))
        mute = lambda c: F.struct(
            either(c["d"], without(both(d1, after_d), either(c["d"], c["s"]))).alias("d"), c["s"].alias("s"))
        ictus = lambda c: F.struct(
            either(c["d"], without(both(d2, after_d), either(c["d"], c["s"]))).alias("d"),
            either(c["s"], without(both(s2, after_s), either(c["d"], c["s"]))).alias("s"))
        return let(let(let(strict, mute), ictus), lambda c: F.struct(
            either(c["d"], c["s"]).alias("ok"), F.concat(F.array(c), acc["at"]).alias("at")))

    def step(acc, at):
        d, s = both(at["d"], acc["here"]) != 0, both(at["s"], acc["here"]) != 0
        return F.struct(
            F.when(d, F.shiftright(acc["here"], 9)).otherwise(F.shiftright(acc["here"], 6)).alias("here"),
            F.when((acc["feet"] == AMBIGUOUS) | (d & s), AMBIGUOUS)
            .otherwise(F.concat(acc["feet"], F.when(d, "D").otherwise("S"))).alias("feet"))

    back = F.aggregate(F.array(*[F.lit(f) for f in range(5, 0, -1)]),
                       F.struct(final.alias("ok"), F.array().cast("array<struct<d:bigint,s:bigint>>").alias("at")), foot)
    return F.aggregate(back["at"], F.struct(first_digit(n).alias("here"), F.lit("").alias("feet")), step,
                       lambda acc: F.when(acc["feet"] == AMBIGUOUS, AMBIGUOUS).otherwise(F.concat(acc["feet"], F.lit("F"))))


def places(feet) -> Column:
    """The length each place of the feet asks for; X for the free last syllable."""
    t = F.replace(_col(feet), F.lit("D"), F.lit("lss"))
    t = F.replace(t, F.lit("S"), F.lit("ll"))
    return F.translate(F.replace(t, F.lit("F"), F.lit("lX")), "ls", "LS")


def resolved_long(feet, short) -> Column:
    """S-12: the set of long syllables: the place decides, the last is long unless short."""
    asked = F.conv(F.translate(places(feet), "LSX", "100"), 8, 10).cast("long")
    return either(asked, without(F.lit(1).cast("long"), _col(short)))
