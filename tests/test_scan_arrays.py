"""Lines read in batches against the same lines read by the expressions."""

import random

import numpy as np
from pyspark.sql import functions as F

from stichos.functions import phonemes as ph
from stichos.operators import scan_arrays as sa, scansion as sc

PARTS = ("te tew tea teoi neo e.w ew ewn ea s eas oui aui ui eu a= h w n s s~ z^ z pr pn zv v y c l m t i+ a+i e/w= e)oi( e.a+ e+w tru ka^ ka_ u^_ ei_ oi^ "
         "o_i kr d bv x i^ j ei= a| ' | = _ . .^ z.^").split(" ")


def _lines(spark, count):
    draw = random.Random(7)
    rows = [(0, None), (1, ""), (2, "b d'"), (3, "^te"), (4, "te\nte ~ "), (5, "É te tew ")]
    for k in range(len(rows), count):
        words = [draw.choice(PARTS) + draw.choice(("", "", " ", " ", "n ", "s", "' ")) for _ in range(draw.randint(4, 22))]
        if k % 2:
            words = [draw.choice("tlnskr") + draw.choice(("e", "w", "h", "a", "oi", "o", "ea", "ew", "ewn", "eas")) + draw.choice(("", "", "n", " ", " ", "s ", ".")) for _ in range(draw.randint(11, 18))]
        rows.append((k, "".join(words) + " "))
    return spark.createDataFrame(rows, "k int, text string")


def test_batches_and_expressions_read_the_same(spark, monkeypatch):
    lines = _lines(spark, 6_000)
    cases = [(ph.STUDENT, sc.PASSES), (ph.NATIVE, sc.PASSES), (ph.NATIVE, (2, 5))]
    read = lambda: [sorted(map(str, sc.scan_lines(lines, approach=a, passes=p).collect())) for a, p in cases]
    batches = read()
    monkeypatch.setattr(sa, "_KNOWN", np.zeros(256, bool))            # no line is plain
    assert batches == read()
    assert all(sum("scanned=True" in r for r in rows) > 20 for rows in batches)


def test_plain_lines_are_read_in_batches(spark):
    """The expressions only see lines outside of the plain alphabet."""
    lines = _lines(spark, 50)
    plan = sc.scan_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    known = F.arrow_udf(sa.scanner(ph.STUDENT, sc.PASSES), sa.scan_type())("text")["known"]
    odd = {r.k for r in lines.filter("k < 6").select("k", known.alias("known")).collect() if not r.known}
    assert odd == {3, 4, 5}
