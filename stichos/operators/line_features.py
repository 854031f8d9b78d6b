"""What a scanned line tells (L-*) and its sums per book and text (A-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stichos.functions.phonemes import both, either, without

# Counter groups in their fixed order, with their sizes.
COUNTERS = (("spondee", 5), ("run", 5), ("any_caesura", 6), ("masculine", 6), ("feminine", 6),
            ("principal", 3), ("diaeresis", 5), ("correption", 2), ("ictus", 3),
            ("mute_liquid", 6), ("digamma", 6), ("meyer", 3))
COUNTER_NAMES = tuple(f"{g}_{i}" for g, size in COUNTERS for i in range(size))


def spondees(feet: Column) -> Column:
    """L-1: 1 where feet 1 to 5 are spondees."""
    return F.array(*[(F.substr(feet, F.lit(i), F.lit(1)) == "S").cast("int") for i in range(1, 6)])


def spondee_runs(feet: Column) -> Column:
    """L-2: one-hot (double, double double, triple, quadruple, quintuple), longest first."""
    five = F.substr(feet, F.lit(1), F.lit(5))
    kind = (F.when(five == "SSDSS", 1).when(five == "SSSSS", 4).when(F.contains(five, F.lit("SSSS")), 3)
            .when(F.contains(five, F.lit("SSS")), 2).when(F.contains(five, F.lit("SS")), 0).otherwise(-1))
    return F.transform(F.array(*[F.lit(i) for i in range(5)]), lambda i: (kind == i).cast("int"))


def breaks(feet: Column, syl: Column) -> Column:
    """L-3: word ends by place in the foot: struct(masculine[6], feminine[6], diaeresis[5])."""
    before = [F.length(F.translate(F.substr(feet, F.lit(1), F.lit(k)), "SF", "")) + 2 * k for k in range(6)]

    def ends(at: Column) -> Column:
        digit = F.call_function("shiftright", syl["pause"], 3 * (syl["n"] - 1 - at))
        return digit.bitwiseAND(F.lit(1)).cast("int")

    dactyl = [F.substr(feet, F.lit(k + 1), F.lit(1)) == "D" for k in range(6)]
    return F.struct(
        F.array(*[ends(before[k]) for k in range(6)]).alias("masculine"),
        F.array(*[F.when(dactyl[k], ends(before[k] + 1)).otherwise(0) for k in range(6)]).alias("feminine"),
        F.array(*[ends(before[k + 1] - 1) for k in range(5)]).alias("diaeresis"))


def principal_caesura(masculine: Column, feminine: Column) -> Column:
    """L-4: 0 masculine third, 1 feminine third, 2 masculine fourth, else -1."""
    return (F.when(masculine[2] == 1, 0).when(feminine[2] == 1, 1).when(masculine[3] == 1, 2).otherwise(-1))


def syllable_counts(long: Column, syl: Column) -> dict[str, Column]:
    """L-5 ... L-8: counts of bits in intersections of the syllable sets."""
    def pair(bits: Column, first_long: bool) -> list[Column]:
        n_long, n_short = F.bit_count(both(bits, long)), F.bit_count(without(bits, long))
        return [n_long, n_short] if first_long else [n_short, n_long]

    ictus = both(syl["short"], long)
    return {
        "correption": F.array(*pair(syl["corr"], False)),
        "ictus": F.array(F.bit_count(ictus), F.bit_count(both(ictus, syl["pause"])),
                         F.bit_count(without(ictus, syl["pause"]))),
        "mute_liquid": F.array(*pair(either(syl["ml_rl"], syl["ml_mn"]), False),
                               *pair(syl["ml_rl"], False), *pair(syl["ml_mn"], False)),
        "digamma": F.array(*pair(either(syl["dig_c"], syl["dig_h"]), True),
                           *pair(syl["dig_c"], True), *pair(syl["dig_h"], True)),
    }


def meyer_laws(masc: Column, fem: Column, any_: Column, dia: Column, principal: Column) -> Column:
    """L-9: 1 where the law is kept."""
    first = (dia[0] != 1) & (masc[1] != 1) & ((fem[1] == 1) | (dia[1] == 1))
    second = ((principal == 0) & (fem[1] == 1)) | ((principal == 2) & (fem[2] == 1))
    bridged = (any_[3] == 1) | (fem[2] == 1) | (dia[2] == 1) | (dia[3] == 1)
    third = (masc[2] == 1) & (masc[4] == 1) & ~bridged
    return F.array(*[(~broken).cast("int") for broken in (first, second, third)])


def line_features(scans: DataFrame) -> DataFrame:
    """L-10: arrays of small counts per scanned line, NULL where the scan failed."""
    feet, syl = F.col("feet"), F.col("syl")
    ok = F.col("scanned")
    df = scans.withColumn("_b", F.when(ok, breaks(feet, syl)))
    masc, fem, dia = F.col("_b.masculine"), F.col("_b.feminine"), F.col("_b.diaeresis")
    df = df.withColumn("any_caesura", F.when(ok, F.zip_with(masc, fem, lambda m, f: F.greatest(m, f))))
    df = df.withColumn("principal_caesura", F.when(ok, principal_caesura(masc, fem)))
    main = F.col("principal_caesura")
    counts = syllable_counts(F.col("long"), syl)
    return df.select(
        *scans.columns,
        F.when(ok, spondees(feet)).alias("spondee"), F.when(ok, spondee_runs(feet)).alias("run"),
        "any_caesura", masc.alias("masculine"), fem.alias("feminine"), main,
        F.when(ok, F.array(*[(main == i).cast("int") for i in range(3)])).alias("principal"),
        dia.alias("diaeresis"), *[F.when(ok, c).alias(n) for n, c in counts.items()],
        F.when(ok, meyer_laws(masc, fem, F.col("any_caesura"), dia, main)).alias("meyer"))


def meter_counts(features: DataFrame, text: str = "text_name", part: str | None = "book") -> DataFrame:
    """A-1 ... A-11: one row per (text, sub) with n_lines, n_scanned and all counters.

    Lines are summed once per (text, part), with partial sums before the shuffle; the
    overall row is a roll-up of those few rows, not of the lines.
    """
    sums = [F.sum(F.col(g)[i]).alias(f"{g}_{i}") for g, size in COUNTERS for i in range(size)]
    keys = [text] + ([part] if part else [])
    per = features.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.count_if("scanned").alias("n_scanned"), *sums)
    cols = ["n_lines", "n_scanned", *COUNTER_NAMES]
    if not part:
        return per.select(text, F.lit("Overall").alias("sub"), "n_lines", "n_scanned",
                          *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTER_NAMES])
    up = per.rollup(text, part).agg(F.grouping_id().alias("_g"), *[F.sum(c).alias(c) for c in cols]).filter("_g < 3")
    sub = F.when(F.col("_g") == 1, "Overall").otherwise(F.concat(F.lit("Book "), F.col(part).cast("string")))
    return up.select(text, sub.alias("sub"), "n_lines", "n_scanned",
                     *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTER_NAMES])


def percentage_report(counts: DataFrame, text: str = "text_name") -> DataFrame:
    """A-12: counters as count, total, percent and per-line rate, one row each, zero-safe.

    Most counters are shares of scanned lines; correption, mute + liquid and digamma are
    shares of the places where they could have happened.
    """
    paired = {"correption": 2, "mute_liquid": 6, "digamma": 6}
    rows = []
    for group, size in COUNTERS:
        step = 2 if group in paired else 1
        for i in range(0, size, step):
            n = F.col(f"{group}_{i}")
            total = n + F.col(f"{group}_{i + 1}") if step == 2 else F.col("n_scanned")
            rows.append(F.struct(F.lit(group).alias("metric"), F.lit(i // step).alias("place"),
                                 n.alias("n"), total.alias("total")))
    out = counts.select(text, "sub", "n_scanned", F.inline(F.array(*rows)))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return out.select(text, "sub", "metric", "place", "n", "total",
                      safe(100.0 * F.col("n"), F.col("total")).alias("percent"),
                      safe(1.0 * F.col("n"), F.col("n_scanned")).alias("per_line"))
