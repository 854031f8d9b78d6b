"""From parses to dialect counts (R-*).

Votes depend on the token type only, so everything up to one row per token is computed on
the vocabulary; texts enter as counts of (text, book, token), which are summed once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from stichos.functions import text as tx
from stichos.functions.text import let
from stichos.operators.tokens import join_types
from stichos.rules import table, votes

SCOPES = ("combo", "dialect")


# ---- rules on parses (D-*, R-1) -----------------------------------------------------------

def prepare_parses(parses: DataFrame, stem_classes: DataFrame | None = None) -> DataFrame:
    """Add the marks-free columns and the stem class the rules read."""
    df = parses.withColumn("clean", tx.strip_diacritics("form")).withColumn("clean_lemma", tx.strip_diacritics("lemma"))
    if stem_classes is not None:
        df = df.join(stem_classes.select("lemma", "stem_class"), "lemma", "left")
    elif "stem_class" not in df.columns:
        df = df.withColumn("stem_class", F.lit(None).cast("string"))
    return df


def rule_votes(prepared: DataFrame, rules=table.RULE_NAMES) -> DataFrame:
    """R-1: one row per (token, parse_no, rule) that votes, with the combination code.

    All rules of a parse sit in one array, a column of a step of its own: inside a higher-order filter every rule would be
    interpreted. Bound values keep that step out of whole-stage code, whose one method all rules would outgrow.
    """
    about = {r: table.lemmas_of(r) for r in rules}
    cells = lambda some: F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(table.case_expression(r, votes.code_of)).alias("code")) for r in some])
    of_words, others = [r for r in rules if about[r]], [r for r in rules if not about[r]]
    # rules about single words are only tried for their lemmas, which few parses have
    every = []
    if of_words:
        words = sorted(set().union(*(about[r] for r in of_words)))
        known = let(F.col("lemma").isin(*words), lambda v: v)
        every.append(F.when(known, cells(of_words)).otherwise(F.array().cast("array<struct<rule:string,code:int>>")))
    if others:
        every.append(cells(others))
    tried = prepared.select("token", let(F.col("parse_no"), lambda v: v).alias("parse_no"), "n_parses", F.concat(*every).alias("_cells"))
    # the outer form, because Spark would otherwise evaluate the array once more in a filter
    # (size > 0) that it infers and pushes down
    return tried.select("token", "parse_no", "n_parses", F.inline_outer(
        F.filter("_cells", lambda c: c["code"] != votes.NEUTRAL))).filter("rule IS NOT NULL")


def with_parse_count(parses: DataFrame) -> DataFrame:
    """Number of parses per token, by an aggregate and a join back (no window over a token).

    The table is spread by token once; the aggregate, the join and every later step (which
    all group by token and more) keep that partitioning and need no further shuffle.
    """
    n = int(parses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parses.repartition(n, "token")
    return spread.join(spread.groupBy("token").agg(F.count("*").cast("int").alias("n_parses")), "token")


def _code_bit(code: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), code)


def rule_outcomes(voted: DataFrame) -> DataFrame:
    """R-2: per (token, rule): possible max/min, dialects max/min and combos max/min as sets.

    Sets of dialects (3 bits) and combos (27 bits) are ints, built with bit_or.
    """
    v = [votes.decode("code", j) for j in range(3)]
    agg = voted.groupBy("token", "rule", "n_parses").agg(
        F.count("*").alias("_n"), F.bit_or(_code_bit(F.col("code"))).alias("combo_max"),
        *[F.sum(v[j]).alias(f"_s{j}") for j in range(3)])
    bits = lambda test: sum((F.when(test(F.col(f"_s{j}")), 1 << j).otherwise(0) for j in range(3)), F.lit(0))
    return agg.select(
        "token", "rule", F.lit(1).alias("possible_max"), (F.col("_n") == F.col("n_parses")).cast("int").alias("possible_min"),
        "combo_max", F.when(F.bit_count("combo_max") == 1, F.col("combo_max")).otherwise(0).alias("combo_min"),
        bits(lambda s: s > 0).alias("dialect_max"), bits(lambda s: s == F.col("n_parses")).alias("dialect_min"))


def reconcile(voted: DataFrame) -> DataFrame:
    """R-3: one verdict per (token, parse_no) that any rule votes on.

    Yes and no together make an inconsistent yes. If a dialect is a consistent yes and an
    inconsistent one stands before it in dialect order, all inconsistent ones turn to no.
    """
    agg = [F.max(votes.decode("code", j)).alias(f"_hi{j}") for j in range(3)]
    agg += [F.min(votes.decode("code", j)).alias(f"_lo{j}") for j in range(3)]
    per = voted.groupBy("token", "parse_no", "n_parses").agg(*agg)
    odd = [(F.col(f"_hi{j}") == 1) & (F.col(f"_lo{j}") == -1) for j in range(3)]
    first = [F.when(F.col(f"_hi{j}") == 1, 1).when(F.col(f"_lo{j}") == -1, -1).otherwise(0) for j in range(3)]
    sure = [(first[j] == 1) & ~odd[j] for j in range(3)]
    # an inconsistent dialect before the first consistent yes
    fix = ((odd[0] & (sure[1] | sure[2])) | (odd[1] & ~sure[0] & sure[2]))
    final = [F.when(fix & odd[j], -1).otherwise(first[j]) for j in range(3)]
    return per.select("token", "parse_no", "n_parses", *[final[j].alias(f"v{j}") for j in range(3)],
                      *[odd[j].alias(f"odd{j}") for j in range(3)], fix.alias("fixed"))


def token_outcomes(parses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """R-4: per token: combos and dialects possible (max) and certain (min), as sets."""
    full = parses.select("token", "parse_no", "n_parses").join(
        verdicts.drop("n_parses"), ["token", "parse_no"], "left")
    v = [F.coalesce(f"v{j}", F.lit(0)) for j in range(3)]
    yes = sum((F.when(v[j] == 1, 1 << j).otherwise(0) for j in range(3)), F.lit(0))
    agg = full.groupBy("token").agg(
        F.first("n_parses").alias("n_parses"), F.bit_or(_code_bit(votes.encode(v))).alias("combo_max"),
        F.bit_or(yes).alias("dialect_max"), F.sum(F.bit_count(yes)).alias("_n_yes"))
    sure = (F.bit_count("dialect_max") == 1) & (F.col("_n_yes") == F.col("n_parses"))
    return agg.select(
        "token", "n_parses", "combo_max",
        F.when(F.bit_count("combo_max") == 1, F.col("combo_max")).otherwise(0).alias("combo_min"),
        "dialect_max", F.when(sure, F.col("dialect_max")).otherwise(0).alias("dialect_min"))


# ---- sums per text (R-5 ... R-8) ------------------------------------------------------------

def _weighted(n: Column, bits: str, size: int, name: str) -> list[Column]:
    one = lambda k: F.call_function("shiftright", F.col(bits), F.lit(k)).bitwiseAND(F.lit(1))
    return [F.sum(n * one(k)).alias(f"{name}_{k}") for k in range(size)]


def _bounds(n: Column) -> list[Column]:
    return [c for bound in ("max", "min") for c in
            (*_weighted(n, f"combo_{bound}", votes.N_COMBOS, f"combo_{bound}"),
             *_weighted(n, f"dialect_{bound}", 3, f"dialect_{bound}"))]


BOUND_COLUMNS = tuple(f"{scope}_{bound}_{k}" for bound in ("max", "min")
                      for scope, size in (("combo", votes.N_COMBOS), ("dialect", 3)) for k in range(size))


# Tokens of a group with the same sets are summed up first: the sixty sums below are made over kinds of outcomes, not over tokens.
SETS = ("combo_max", "combo_min", "dialect_max", "dialect_min")


def text_counts(counts: DataFrame, outcomes: DataFrame, by: list[str]) -> DataFrame:
    """R-5: tokens, distinct and valid tokens, and all combo and dialect counts per group.

    `counts`: one row per (group, token) with n. Tokens without a parse are not valid.
    """
    valid = F.col("n_parses").isNotNull().alias("_valid")
    alike = join_types(counts, outcomes, ["token"]).groupBy(*by, *SETS, valid).agg(F.sum("n").alias("_n"), F.count("*").alias("_tokens"))
    n = F.col("_n")
    return alike.groupBy(*by).agg(
        F.sum(n).alias("n_tokens"), F.sum("_tokens").alias("n_unique"),
        F.sum(F.when(F.col("_valid"), n).otherwise(0)).alias("n_valid"), *_bounds(F.coalesce(n, F.lit(0))))


def rule_counts(counts: DataFrame, outcomes: DataFrame, by: list[str]) -> DataFrame:
    """R-6: per group and rule: possible, combo and dialect outcomes, max and min."""
    alike = (join_types(counts, outcomes, ["token"]).filter("rule IS NOT NULL")
             .groupBy(*by, "rule", "possible_max", "possible_min", *SETS).agg(F.sum("n").alias("_n")))
    n = F.col("_n")
    return alike.groupBy(*by, "rule").agg(
        F.sum(n * F.col("possible_max")).alias("possible_max"),
        F.sum(n * F.col("possible_min")).alias("possible_min"), *_bounds(n))


def with_overall(per_part: DataFrame, text: str, part: str, sums: list[str], extra: list[str] = ()) -> DataFrame:
    """R-7: books plus their sum, as a roll-up of the few rows per book."""
    keys = list(extra)
    up = (per_part.groupBy(*keys, text, part).agg(*[F.sum(c).alias(c) for c in sums]))
    whole = up.groupBy(*keys, text).agg(*[F.sum(c).alias(c) for c in sums])
    head = whole.select(*keys, text, F.lit("Overall").alias("sub"), *sums)
    body = up.select(*keys, text, F.concat(F.lit("Book "), F.col(part).cast("string")).alias("sub"), *sums)
    return head.unionByName(body)


def dialect_counts(counts: DataFrame, outcomes: DataFrame, text: str = "text_name", part: str = "book",
                   keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """R-7 for R-5: additive counts are summed over books; distinct tokens of the whole
    text are counted again (valid tokens are additive over occurrences). `keep` may store the few rows per part, which are read three times."""
    per_part = keep(text_counts(counts, outcomes, [text, part]))
    sums = ["n_tokens", "n_valid", *BOUND_COLUMNS]
    both = with_overall(per_part, text, part, sums)
    unique_part = per_part.select(text, F.concat(F.lit("Book "), F.col(part).cast("string")).alias("sub"), "n_unique")
    unique_all = (counts.groupBy(text, "token").agg(F.lit(1).alias("one")).groupBy(text)
                  .agg(F.count("*").alias("n_unique")).select(text, F.lit("Overall").alias("sub"), "n_unique"))
    return both.join(unique_part.unionByName(unique_all), [text, "sub"])


def as_long(wide: DataFrame, keys: list[str], rule: str | None = None) -> DataFrame:
    """R-8 / M17: long table (keys, rule, bound, kind, idx, n)."""
    cells = F.array(*[F.struct(F.lit(b).alias("bound"), F.lit(k).alias("kind"), F.lit(i).alias("idx"),
                               F.col(f"{k}_{b}_{i}").cast("long").alias("n"))
                      for b in ("max", "min") for k, size in (("combo", votes.N_COMBOS), ("dialect", 3))
                      for i in range(size)])
    return wide.select(*keys, (F.col(rule) if rule else F.lit("")).alias("rule"), F.inline(cells))


# ---- comparison and reports (R-10 ... R-14) ---------------------------------------------------

def _tagged(parses: DataFrame, verdicts: DataFrame, counts: DataFrame | None, tag: str, *more: str) -> DataFrame:
    """(n, more ..., dialect_name, ours, theirs) per parse and dialect; n is 1, or how often the token occurs."""
    df = parses.select("token", "parse_no", tag, *more).join(verdicts, ["token", "parse_no"], "left")
    n = F.lit(1)
    if counts is not None:
        df = df.join(counts.groupBy("token").agg(F.sum("n").alias("_n")), "token")
        n = F.col("_n")
    cells = F.array(*[F.struct(
        F.lit(name).alias("dialect_name"), (F.coalesce(f"v{j}", F.lit(0)) == 1).alias("ours"),
        F.coalesce(F.contains(tag, F.lit(votes.EXTERNAL_TAGS[j])), F.lit(False)).alias("theirs"))
        for j, name in enumerate(votes.DIALECTS)])
    return df.select(n.alias("n"), tag, *more, F.inline(cells))


def tag_agreement(parses: DataFrame, verdicts: DataFrame, counts: DataFrame | None = None,
                  tag: str = "dialect") -> DataFrame:
    """R-10: our verdicts against the dialect tags of the morphology, per dialect; with `counts` every occurrence of a token counts."""
    rows = _tagged(parses, verdicts, counts, tag)
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    agg = rows.groupBy("dialect_name").agg(
        count(F.col("ours") & F.col("theirs")).alias("n_both"), count(F.col("ours") & ~F.col("theirs")).alias("n_ours"),
        count(~F.col("ours") & F.col("theirs")).alias("n_theirs"), count(~F.col("ours") & ~F.col("theirs")).alias("n_neither"))
    total = sum((F.col(c) for c in ("n_both", "n_ours", "n_theirs", "n_neither")), F.lit(0))
    return agg.withColumn("agree_percent", 100.0 * (F.col("n_both") + F.col("n_neither")) / total)


SAMPLE_DIGITS = 12


def tag_samples(parses: DataFrame, verdicts: DataFrame, size: int, counts: DataFrame | None = None, tag: str = "dialect",
                shown: tuple[str, ...] = ("lemma", "form")) -> DataFrame:
    """R-10: per dialect and outcome (both, ours, theirs) a sample of the parses, with how often each occurs.

    Equal parses (by `shown` and tag) are one, with their number n. Each draws u in (0, 1) from an md5 of what it is, and the `size` smallest of
    -ln(u) / n stay: a draw weighted by n without replacement, the same whatever the order or partitioning of the rows. The smallest few of each
    partition are enough for the smallest few of all, so a sample is cut down before it is shuffled.
    """
    outcome = F.when(F.col("ours") & F.col("theirs"), "both").when(F.col("ours"), "ours").when(F.col("theirs"), "theirs")
    rows = _tagged(parses, verdicts, counts, tag, *shown).withColumn("outcome", outcome).filter("outcome IS NOT NULL")
    per = rows.groupBy("dialect_name", "outcome", *shown, tag).agg(F.sum("n").alias("n"))
    digest = F.md5(F.concat_ws("#", "dialect_name", "outcome", *[F.coalesce(c, F.lit("")) for c in (*shown, tag)]).cast("binary"))
    u = (F.conv(F.left(digest, F.lit(SAMPLE_DIGITS)), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16 ** SAMPLE_DIGITS))
    order = Window.partitionBy("dialect_name", "outcome").orderBy("_draw", *shown, tag)
    ranked = per.withColumn("_draw", -F.log(u) / F.col("n")).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= size).drop("_draw")


def collapse_parses(parses: DataFrame, columns: list[str]) -> DataFrame:
    """R-11: identical parses once, with their number."""
    return parses.groupBy(*columns).agg(F.count("*").alias("n"))


def _named(bits: str, prefix: str = "") -> list[Column]:
    bit = lambda j: F.call_function("shiftright", F.col(bits), F.lit(j)).bitwiseAND(F.lit(1)) == 1
    return [F.when(bit(j), F.lit(prefix + d)) for j, d in enumerate(votes.DIALECTS)]


def token_report(outcomes: DataFrame) -> DataFrame:
    """R-12: Definitely / Possibly per dialect, or no marker."""
    sure, may = _named("dialect_min", "Definitely "), _named("dialect_max", "Possibly ")
    text = F.concat_ws(", ", *[F.coalesce(s, m) for s, m in zip(sure, may)])
    return outcomes.select("token", F.when(text == "", "No clear dialect markers").otherwise(text).alias("summary"))


def parse_reasons(voted: DataFrame, verdicts: DataFrame) -> DataFrame:
    """R-12, per parse: dialects with the rules that speak for them.

    A dialect that lost because it was inconsistent keeps no reasons. At most one row per
    rule and dialect is collected, so a list never holds more than the 42 rules.
    """
    cells = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(d).alias("dialect_name"),
                               (votes.decode("code", j) == 1).alias("yes")) for j, d in enumerate(votes.DIALECTS)])
    rows = voted.select("token", "parse_no", "rule", F.inline(cells)).filter("yes")
    kept = rows.join(verdicts, ["token", "parse_no"]).filter(
        F.when(F.col("j") == 0, F.col("v0")).when(F.col("j") == 1, F.col("v1")).otherwise(F.col("v2")) == 1)
    return kept.groupBy("token", "parse_no", "dialect_name").agg(
        F.array_join(F.array_sort(F.collect_set("rule")), ", ").alias("reasons"))


def rule_report(rule_sums: DataFrame, by: list[str]) -> DataFrame:
    """R-13: occurrences per rule and dialect."""
    return rule_sums.select(*by, "rule", "possible_max", "possible_min",
                            *[F.col(f"dialect_{b}_{j}").alias(f"{d.lower()}_{b}")
                              for j, d in enumerate(votes.DIALECTS) for b in ("max", "min")])


def check_expectations(prepared: DataFrame, expected: DataFrame) -> DataFrame:
    """R-14: expectations (rule, token, parse_no or -1 for all, expected) that fail.

    `expected` names a dialect the rule must allow for the token, or `none`.
    """
    voted = rule_votes(prepared).select("token", "parse_no", "rule", "code")
    rows = expected.select("rule", "token", F.col("parse_no").alias("_want"), "expected").join(
        voted, ["token", "rule"], "left")
    hit = F.col("parse_no").isNotNull() & ((F.col("_want") == -1) | (F.col("_want") == F.col("parse_no")))
    yes = [F.max(F.when(hit & (votes.decode("code", j) == 1), 1).otherwise(0)).alias(f"_y{j}") for j in range(3)]
    seen = rows.groupBy("rule", "token", "_want", "expected").agg(*yes)
    wanted = F.coalesce(*[F.when(F.col("expected") == d, F.col(f"_y{j}") == 1) for j, d in enumerate(votes.DIALECTS)],
                        (F.col("_y0") + F.col("_y1") + F.col("_y2")) == 0)
    return seen.filter(~wanted).select("rule", "token", F.col("_want").alias("parse_no"), "expected")
