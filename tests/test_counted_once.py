"""Dialect queries read the documents in one pass, and sum up like outcomes before they spell out their bits."""

import re

from stichos.operators import dialect as di


def test_documents_are_read_once(spark):
    from queries import all_queries
    for name in ("r06_rule_counts", "r05_r07_text_counts"):
        files = all_queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not any("documents.parquet" in f for f in files)


def test_like_outcomes_are_summed_up_first(spark):
    counts = spark.createDataFrame([("A", "x", 2), ("A", "y", 3), ("A", "z", 5), ("A", "q", None), (None, "x", 7)], "text_name string, token string, n bigint")
    outcomes = spark.createDataFrame([("x", 1, 1, 1, 1, 1), ("y", 2, 1, 1, 1, 1), ("z", 1, 6, 0, 3, 0)],
                                     "token string, n_parses int, combo_max int, combo_min int, dialect_max int, dialect_min int")
    df = di.text_counts(counts, outcomes, ["text_name"])
    got = {r.text_name: r for r in df.collect()}
    assert (got["A"].n_tokens, got["A"].n_unique, got["A"].n_valid) == (10, 4, 10)
    assert (got["A"].combo_max_0, got["A"].combo_max_1, got["A"].combo_max_2, got["A"].dialect_max_0, got["A"].dialect_max_1, got["A"].combo_min_0) == (5, 5, 5, 10, 5, 5)
    assert (got[None].n_tokens, got[None].combo_max_0) == (7, 7)
    sums = [len(re.findall(r"sum\(", x)) for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert sums[0] > 20 and sums[-1] < 3                              # a plan shows 25 columns
