"""The feature matrix, kept long: (text, sub, feature_idx, value) (F-*)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stichos.operators.line_features import COUNTERS
from stichos.rules import table, votes

# The names of features, here and in the two functions below.
RUN_TYPES = ("Single Double", "Double Double", "Triple", "Quadruple", "Quintuple")
MUTE_LIQUID = ("r/l/n/m", "r/l", "n/m")


def meter_features() -> list[tuple[str, Column]]:
    """F-1: the 51 metre features in order, as Columns over the counters of a row."""
    done = F.col("n_scanned")
    share = lambda a, b, default=0.0: F.when(b > 0, a / b).otherwise(default)
    per = lambda c: share(F.col(c), done)
    out = [(f"Foot {i + 1} is spondaic", per(f"spondee_{i}")) for i in range(5)]
    out += [(f"Spondaic Runs: {RUN_TYPES[i]}", per(f"run_{i}")) for i in range(5)]
    for group, name in (("any_caesura", "Some"), ("masculine", "Masculine"), ("feminine", "Feminine"), ("principal", "Principal")):
        out += [(f"{name} caesura at position {i}", per(f"{group}_{i}")) for i in range(dict(COUNTERS)[group])]
    out += [(f"Diaeresis at position {i}", per(f"diaeresis_{i}")) for i in range(5)]
    happened = lambda g, i=0: share(F.col(f"{g}_{2 * i}"), F.col(f"{g}_{2 * i}") + F.col(f"{g}_{2 * i + 1}"))
    out += [("Frequency correption happened when it could have", happened("correption")),
            ("Overall correption frequency", per("correption_0"))]
    out += [("Overall Ictus Lengthening frequency", per(f"ictus_{i}")) for i in range(3)]
    out += [("Percentage of ictus lengthenings followed by space", share(F.col("ictus_1"), F.col("ictus_0"), 1.0))]
    for i, name in enumerate(MUTE_LIQUID):
        out += [(f"Mute Liquid ({name}) frequency in places it could have happened", happened("mute_liquid", i)),
                (f"Total Mute Liquid ({name}) frequency", per(f"mute_liquid_{2 * i}"))]
    out += [(f"Meyer's Law {i + 1} frequency", per(f"meyer_{i}")) for i in range(3)]
    return out


def meter_vector(counts: DataFrame, text: str = "text_name") -> DataFrame:
    """F-1, long. A text without a scanned line is all zeros."""
    cells = F.array(*[F.struct(F.lit(i).alias("feature_idx"),
                               F.when(F.col("n_scanned") > 0, v).otherwise(0.0).cast("double").alias("value"))
                      for i, (_, v) in enumerate(meter_features())])
    return counts.select(text, "sub", F.inline(cells))


def dialect_layout(rules=table.RULE_NAMES) -> list[tuple[str, str, str, int]]:
    """(bound, rule or '', kind, idx) in matrix order."""
    cells = [("combo", k) for k in range(votes.N_COMBOS)] + [("dialect", k) for k in range(3)]
    return [(bound, rule, kind, k) for bound in ("max", "min") for rule in ("", *rules) for kind, k in cells]


def _combo_text(code: int) -> str:
    said = [(f"Definitely {d}", None, f"Definitely Not {d}")[1 - (code // 3 ** j % 3 - 1)] for j, d in enumerate(votes.DIALECTS)]
    return ", ".join(s for s in said if s) or "Any Dialect"


def feature_names(rules=table.RULE_NAMES) -> list[str]:
    """F-4: all names in matrix order: 51 metre features, then the dialect ones."""
    names = [n for n, _ in meter_features()]
    for bound, rule, kind, k in dialect_layout(rules):
        what = f"Combo [{_combo_text(k)}]" if kind == "combo" else f"Dialect {votes.DIALECTS[k]}"
        scope = f"{bound.title()}, {rule}: {table.RULES[rule][0]}" if rule else bound.title()
        names.append(f"{what} frequency ({scope})")
    return names


def feature_dimension(spark: SparkSession, rules=table.RULE_NAMES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(feature_names(rules))), "feature_idx int, feature string")


def dialect_vector(long_counts: DataFrame, valid: DataFrame, keys: list[str], first_idx: int = 51,
                   rules=table.RULE_NAMES) -> DataFrame:
    """F-2: every count over the valid tokens of its row; cells no token reached are zero.

    long_counts: (keys, rule, bound, kind, idx, n). The index is arithmetic on the layout,
    so no layout table is joined; absent cells stay absent until the matrix is assembled.
    """
    per_rule = votes.N_COMBOS + 3
    rule_no = F.coalesce(F.try_element_at(F.create_map(*[x for i, r in enumerate(("", *rules)) for x in (F.lit(r), F.lit(i))]),
                                          F.col("rule")), F.lit(None).cast("int"))
    idx = (F.lit(first_idx) + F.when(F.col("bound") == "max", 0).otherwise((len(rules) + 1) * per_rule)
           + rule_no * per_rule + F.when(F.col("kind") == "combo", 0).otherwise(votes.N_COMBOS) + F.col("idx"))
    return (long_counts.join(valid.select(*keys, "n_valid"), keys)
            .select(*keys, idx.alias("feature_idx"),
                    F.when(F.col("n_valid") > 0, F.col("n") / F.col("n_valid")).otherwise(0.0).alias("value")))


def assert_same_rows(meter: DataFrame, dialect: DataFrame, keys: list[str]) -> DataFrame:
    """F-3: rows that only one side has; the matrix must not be built unless it is empty."""
    a = meter.select(*keys).distinct().withColumn("_m", F.lit(1))
    b = dialect.select(*keys).distinct().withColumn("_d", F.lit(1))
    return a.join(b, keys, "full").filter("_m IS NULL OR _d IS NULL").select(
        *keys, F.when(F.col("_m").isNull(), "metre").otherwise("dialect").alias("missing"))


def assemble(meter: DataFrame, dialect: DataFrame, keys: list[str]) -> DataFrame:
    """F-3: both halves of every row. A row that one half lacks fails the job."""
    bad = assert_same_rows(meter, dialect, keys).withColumnRenamed("missing", "_missing")
    long_ = meter.unionByName(dialect)
    return (long_.join(bad, keys, "left")
            .filter(F.when(F.col("_missing").isNotNull(), F.raise_error(F.concat_ws(" ", F.lit("no counterpart for"), *keys)))
                    .otherwise(F.lit(True))).drop("_missing"))


def row_vectors(long_: DataFrame, keys: list[str], width: int) -> DataFrame:
    """F-5: one dense array per row; the width is fixed, so a group holds at most that many
    cells. Missing cells are zero. Cells are put in their places in Arrow batches: a look-up in a map per place would be a search each."""
    cells = long_.groupBy(*keys).agg(F.collect_list("feature_idx").alias("_at"), F.collect_list("value").alias("_value"))

    @F.pandas_udf("array<double>")
    def dense(at: pd.Series, value: pd.Series) -> pd.Series:
        out = np.zeros((len(at), width))
        for row, (i, v) in enumerate(zip(at, value)):
            out[row, np.asarray(i, dtype=int)] = v
        return pd.Series(list(out), dtype=object)

    pairs = F.filter(F.arrays_zip("_at", "_value"), lambda x: x["_at"].between(0, width - 1))
    return cells.withColumn("_in", pairs).select(*keys, dense(F.col("_in")["_at"], F.col("_in")["_value"]).alias("features"))
