"""Validation schemes as fold tables (P-14 ... P-17).

A fold table says in which fold a row is tested; its training rows are all rows of other
folds, which never have to be written out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_DIGITS = 3


def shuffle_key(name, seed: int) -> Column:
    """A fixed pseudo-random order: md5 of name and seed, the same in any SQL engine."""
    return F.md5(F.concat_ws("#", F.col(name) if isinstance(name, str) else name, seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))).cast("binary"))


def hash_rank(rows: DataFrame, name: str, seed: int, within: list[str] = ()) -> DataFrame:
    """Rank of every row in the md5 order of its group, and the size of the group.

    The first hex digits cut a group into 4096 even buckets: counts per bucket give the
    offset, and rows are only sorted inside a bucket. No task sees a whole group.
    """
    keyed = rows.withColumn("_key", shuffle_key(name, seed)).withColumn("_bucket", F.left("_key", F.lit(BUCKET_DIGITS)))
    sizes = keyed.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    one = [F.lit(0)] if not within else list(within)
    ordered = Window.partitionBy(*one).orderBy("_bucket")
    offsets = (sizes.withColumn("_before", F.sum("_n").over(ordered) - F.col("_n"))
               .withColumn("group_size", F.sum("_n").over(Window.partitionBy(*one))).drop("_n"))
    inside = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy("_key", name))
    return (keyed.withColumn("_in", inside).join(offsets, [*within, "_bucket"])
            .withColumn("rank", F.col("_before") + F.col("_in")).drop("_key", "_bucket", "_in", "_before"))


def random_splits(rows: DataFrame, name: str, n_splits: int = 5, test_share: float = 0.1) -> DataFrame:
    """P-14: repeated random splits: the first tenth (rounded up) of each seeded order; the rows are read once."""
    seeds = rows.select(name, F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split"))
    ranked = hash_rank(seeds, name, F.col("split"), ["split"])
    return ranked.select("split", name, (F.col("rank") <= F.ceil(F.col("group_size") * F.lit(test_share))).alias("is_test"))


def stratified_folds(rows: DataFrame, name: str, group: str, n_folds: int = 5, seed: int = 10) -> DataFrame:
    """P-15: k folds drawn evenly from every group; the first folds take what is left over."""
    ranked = hash_rank(rows.select(name, group), name, seed, [group])
    size = F.floor(F.col("group_size") / n_folds)
    rest = F.col("group_size") % n_folds
    r = F.col("rank")
    fold = F.when(r <= rest * (size + 1), F.ceil(r / (size + 1))).otherwise(rest + F.ceil((r - rest * (size + 1)) / size))
    return ranked.select(name, group, fold.cast("int").alias("fold"))


def three_groups(text) -> Column:
    """The groups of P-15: Homer, the hymns, everything else."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.isin("Iliad", "Odyssey"), "homeric").when(F.left(t, F.lit(5)) == "Hymns", "pseudo").otherwise("other")


def leave_one_out(rows: DataFrame, name: str) -> DataFrame:
    """P-16: every row is its own fold."""
    return rows.select(name, F.col(name).alias("fold"))


def leave_group_out(rows: DataFrame, name: str, group: str, held_out: list) -> DataFrame:
    """P-17: one fold per named group; rows of other groups (fold NULL) only train."""
    return rows.select(name, F.when(F.col(group).isin(*held_out), F.col(group)).alias("fold"))
