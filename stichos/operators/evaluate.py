"""Scans against the truth, another scanner and each other (E-*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stichos.functions.text import _col


def parse_feet(notation) -> Column:
    """E-1: `--|-uu|...|-x` to six letters; NULL unless there are six known parts."""
    parts = F.split(_col(notation), r"\|")
    letters = F.transform(parts, lambda p: F.when(p == "--", "S").when(p == "-uu", "D").when(p == "-x", "F"))
    return F.when((F.size(parts) == 6) & F.forall(letters, lambda x: x.isNotNull()), F.array_join(letters, ""))


OUTCOMES = ("agree", "differ", "ours_failed", "theirs_failed", "both_failed")


def outcome(ours: Column, theirs: Column) -> Column:
    """Feet of two sides, NULL where a side failed."""
    return (F.when(ours.isNotNull() & theirs.isNotNull(), F.when(ours == theirs, "agree").otherwise("differ"))
            .when(ours.isNotNull(), "theirs_failed").when(theirs.isNotNull(), "ours_failed").otherwise("both_failed"))


def compare(ours: DataFrame, theirs: DataFrame, keys: list[str], how: str = "right",
            ours_col: str = "feet", theirs_col: str = "target") -> DataFrame:
    """E-2 (truth, every target counts: right side kept), E-3 and E-6 (other scanner), E-4 (approaches)."""
    a = ours.select(*keys, F.col(ours_col).alias("ours"))
    b = theirs.select(*keys, F.col(theirs_col).alias("theirs"))
    return a.join(b, keys, how).withColumn("outcome", outcome(F.col("ours"), F.col("theirs")))


def truth(feet5: DataFrame) -> DataFrame:
    """The last foot is not part of the truth files."""
    return feet5.withColumn("target", F.concat("feet5", F.lit("F")))


def agreement(compared: DataFrame, by: list[str]) -> DataFrame:
    """E-7 and the totals of E-2 ... E-4, E-6."""
    n = [F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    out = compared.groupBy(*by).agg(F.count("*").alias("n_lines"), *n) if by else compared.agg(F.count("*").alias("n_lines"), *n)
    return out.withColumn("differ_percent", F.when(F.col("n_lines") > 0, 100.0 * F.col("n_differ") / F.col("n_lines")).otherwise(0.0))


def disagreements(compared: DataFrame) -> DataFrame:
    return compared.filter("outcome <> 'agree'")


def all_same(scans: DataFrame, keys: list[str], feet: str = "feet") -> DataFrame:
    """E-5: whether all scans of a line are equal, by the smallest and the largest."""
    return scans.groupBy(*keys).agg(F.count("*").alias("n_scans"),
                                    (F.coalesce(F.min(feet) == F.max(feet), F.lit(True))
                                     & ((F.count(feet) == F.count("*")) | (F.count(feet) == 0))).alias("same"))
