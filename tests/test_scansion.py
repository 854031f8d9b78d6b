"""Scansion on verse typed by hand, and properties of all readings."""

import re

from pyspark.sql import functions as F

from stichos.functions import feet as ft, phonemes as ph, text as tx
from stichos.operators import evaluate as ev, lexicon as lx, line_features as lf, scansion as sc

# line, text, feet of the first five places, pass that finds it (None: several readings)
VERSES = [
    (1, "mh=nin a)/eide qea\\ *phlhi+a/dew *)axilh=os", "DDSDD", 2),
    (2, "ou)lome/nhn, h(\\ muri/' *)axaioi=s a)/lge' e)/qhke,", "DSDSD", 1),
    (3, "polla\\s d' i)fqi/mous yuxa\\s *)/ai+di proi+/ayen", "SSSDD", None),
    (4, "h(rw/wn, au)tou\\s de\\ e(lw/ria teu=xe ku/nessin", "SSDDD", 1),
    (5, "oi)wnoi=si/ te pa=si, *dio\\s d' e)telei/eto boulh/,", "SDDDD", 1),
]


def _lines(spark):
    return spark.createDataFrame([("A", 1, n, t, f) for n, t, f, _ in VERSES],
                                 "text_name string, book int, line int, text string, feet5 string")


def test_known_verses(spark):
    got = {r.line: r for r in sc.scan_lines(sc.clean_verses(_lines(spark))).collect()}
    for n, _, feet, pass_no in VERSES:
        if pass_no is None:
            assert got[n].ambiguous and not got[n].scanned and got[n].feet is None
        else:
            assert (got[n].feet, got[n].scan_pass) == (feet + "F", pass_no)


def test_truth_comparison(spark):
    lines = _lines(spark)
    out = ev.compare(sc.scan_lines(sc.clean_verses(lines)), ev.truth(lines), ["line"])
    assert {r.outcome: r["count"] for r in out.groupBy("outcome").count().collect()} == {"agree": 4, "ours_failed": 1}
    # a line of the truth that was not scanned counts, a scanned line without truth does not
    few = ev.compare(sc.scan_lines(sc.clean_verses(lines.filter("line < 3"))), ev.truth(lines.filter("line > 1")), ["line"])
    assert {(r.line, r.outcome) for r in few.collect()} == {(2, "agree"), (3, "ours_failed"), (4, "ours_failed"), (5, "ours_failed")}


def test_lines_with_many_vowels_to_run_together(spark):
    rows = [(k, "tew tew e " * k + "tew te te " * (5 - k) + "tew tew ") for k in range(6)]
    got = sc.scan_lines(sc.clean_verses(spark.createDataFrame(rows, "line int, text string"))).collect()
    assert [(r.feet, r.scan_pass) for r in sorted(got, key=lambda r: r.line)][1:4] == [("DDDDDF", 2)] * 3


def test_marks_that_stand_alone(spark):
    rows = [(0, "tewt nh " * 6), (1, "tewt | nh " + "tewt nh " * 5), (2, "tewt nh " * 5 + "tewt ' nh "), (3, "= tewt nh " * 6), (4, "tewt nh " * 6 + "' "), (5, "tewt nh / " * 6)]
    got = sc.scan_lines(sc.clean_verses(spark.createDataFrame(rows, "line int, text string"))).collect()
    assert {r.line: (r.feet, r.scan_pass) for r in got} == {k: ("SSSSSF", 2) for k, _ in rows}
    # the deepest level has its own pairs
    rows = [(0, "teas nh " * 6), (1, "teas ' nh " * 6), (2, "tea | s nh " * 6), (3, "tea s nh " * 6)]
    got = sc.scan_lines(sc.clean_verses(spark.createDataFrame(rows, "line int, text string")), passes=(5,)).collect()
    feet = {r.line: r.feet for r in got}
    assert feet[0] == feet[1] and feet[2] == feet[3]


def test_words_with_many_vowels(spark):
    rows = [("w", 0, "w", "l" * 70), ("w", 1, "w", "l" * 69 + "s"), ("x", 0, "x", "ls"), ("x", 1, "x", "l"), ("y", 0, "y", "")]
    got = {r.token: (r.unified, r.lengths) for r in lx.unify_lengths(spark.createDataFrame(rows, "token string, parse_no int, spelling string, lengths string")).collect()}
    assert got == {"w": (True, "l" * 69 + "?"), "x": (False, None), "y": (True, "")}


def test_native_reading_of_unknown_words(spark):
    lines = spark.createDataFrame([(1, "tei tou ")], "line int, text string")
    none = spark.createDataFrame([], "token string, sound string, enclitic boolean, proclitic boolean")
    sound = sc.line_sounds(lines, none, ["line"], approach=ph.NATIVE).first().sound_text
    assert ph.NATIVE and sound == "t.ei_ t.ou_ "


def test_combined_texts_keep_their_lines_apart(spark):
    from stichos.plans import pipeline
    lines = spark.createDataFrame([("A", 1, 1, 0, VERSES[1][1]), ("A", 1, 1, 1, VERSES[3][1])], "text_name string, book int, line int, source_pos int, text string")
    forms = spark.createDataFrame([("te", 0, "te", "te", None, None)], "token string, parse_no int, form string, lemma string, tense string, mood string")
    got = {r.source_pos: r.feet for r in pipeline.scan_corpus(lines, forms, approach=ph.STUDENT).collect()}
    assert got == {0: VERSES[1][2] + "F", 1: VERSES[3][2] + "F"}


def test_syllables_follow_from_feet(spark):
    rows = sc.scan_lines(sc.clean_verses(_lines(spark))).filter("scanned").select("feet", "syl.n", F.bit_count("long").alias("long")).collect()
    assert len(rows) == 4
    for r in rows:
        dactyls = r.feet.count("D")
        assert r.n == 12 + dactyls
        assert r.long in (11 - dactyls, 12 - dactyls)


def test_overall_is_the_sum_of_books(spark):
    two = _lines(spark).unionByName(_lines(spark).withColumn("book", F.lit(2)))
    rows = {r["sub"]: r for r in lf.meter_counts(lf.line_features(sc.scan_lines(sc.clean_verses(two)))).collect()}
    for c in ("n_lines", "n_scanned", *lf.COUNTER_NAMES):
        assert rows["Overall"][c] == rows["Book 1"][c] + rows["Book 2"][c]
    assert rows["Book 1"]["n_scanned"] == 4 and rows["Book 1"]["spondee_0"] == 2


def test_spondee_runs(spark):
    cases = {"DDDDD": None, "DDDDS": None, "SDSDS": None, "SSDDS": 0, "SSDSD": 0, "DSDSS": 0, "SSDSS": 1, "SDSSS": 2,
             "DSSSD": 2, "SSSDD": 2, "SSSSD": 3, "DSSSS": 3, "SSSSS": 4}
    df = spark.createDataFrame([(k + "F",) for k in cases], "feet string")
    for r in df.select("feet", lf.spondee_runs(F.col("feet")).alias("run")).collect():
        want = cases[r.feet[:5]]
        assert list(r.run) == [int(i == want) for i in range(5)]


def test_clitics_join(spark):
    lines = spark.createDataFrame([(1, "a)/ndra te e)/nnepe e)k po/lews ")], "line int, text string")
    forms = spark.createDataFrame([("te", 0, "te", "te", None, None), ("e)k", 0, "e)k", "e)k", None, None)],
                                  "token string, parse_no int, form string, lemma string, tense string, mood string")
    out = sc.line_sounds(lines, lx.student_tokens(forms), ["line"]).first()
    assert out.sound_text == "a)/ndra.te e)/nnepe e)k.po/lews "


def test_relaxed_levels(spark):
    """n, long, short, pause, mute+liquid places (first syllable first), level, feet."""
    def bits(flags):
        return int(flags.replace(".", "0").replace("x", "1"), 8)
    # twelve long syllables; the last foot is free
    cases = [("x" * 12, "." * 12, "." * 12, "." * 12, 0, "SSSSSF"),
             # a long before mute + liquid where a short is needed
             ("x" * 1 + "x" + "." + "x" * 10, "..x" + "." * 10, "." * 13, ".x" + "." * 11, 1, "DSSSSF"),
             # a short at word end in the first place
             ("." + "x" * 11, "x" + "." * 11, "x" + "." * 11, "." * 12, 2, "SSSSSF")]
    for long_, short, pause, ml, level, want in cases:
        n = len(long_)
        b = {"n": F.lit(n), "long": F.lit(bits(long_)).cast("long"), "short": F.lit(bits(short)).cast("long"),
             "pause": F.lit(bits(pause)).cast("long"), "ml_rl": F.lit(bits(ml)).cast("long"), "ml_mn": F.lit(0).cast("long")}
        at = ft.foot_starts(ft.weights(b))
        df = spark.range(1)
        for lower in range(level):
            ok = ft.readable(at, lower, None, 5)
            assert df.select(ph.both(ok, ft.first_digit(F.lit(n))) == 0).first()[0]
        assert df.select(ft.feet_of(at, F.lit(n), F.lit(level))).first()[0] == want


def test_line_without_words(spark):
    df = spark.createDataFrame([(1, ""), (2, "b d'"), (3, None)], "line int, text string")
    rows = sc.scan_lines(sc.clean_verses(df)).collect()
    assert len(rows) == 3 and not any(r.scanned or r.ambiguous for r in rows)


def test_normalisation(spark):
    cases = {"*)axilh=os": "a)xilh=os", "*dio\\s": "dio/s", "=(ws": "(=ws", "a)/nqrwpo/s": "a)/nqrwpos", "dia/doxa/": "dia/doxa/"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.s for r in df.select("t", tx.standardize("t").alias("s")).collect()}
    assert got["*)axilh=os"] == "a)xilh=os" and got["*dio\\s"] == "dio/s" and got["a)/nqrwpo/s"] == "a)/nqrwpos"
    assert got["dia/doxa/"] == "dia/doxa/"


def _facts_by_hand(pattern, shorten="AY"):
    parts = re.findall(rf"[A-Z]\|?[{ph.KINDS}]", pattern)
    classes, corr = "", 0
    for i, p in enumerate(parts):
        opened = p.endswith("|v") or (p.endswith("|o") and i < len(parts) - 1)
        corr += opened and p[0] in shorten
        classes += "L" if p[-1] in "xz469" or (p[0] in "AY" and not opened) else "S" if p[0] in "EB" and p[-1] not in "89<" else "U"
    some = [p for p in parts if p[0] != "Y"]
    return (len(parts), classes, sum("|" in p for p in parts), corr, sum(p[-1] in "46" for p in some), sum(p[-1] in "89" for p in some),
            sum(p.endswith("|v") for p in some))


def test_syllable_facts_of_all_pairs(spark):
    cells = [a + b + c for a in ph.NUCLEI for b in ("", "|") for c in ph.KINDS]
    rows = [(x + y,) for x in cells for y in cells[::7]] + [("".join(cells),), ("".join(cells[::-1]),), ("",)]
    df = spark.createDataFrame(rows, "p string")
    for approach, shorten in ((ph.STUDENT, "AY"), (ph.NATIVE, "AYDB")):
        f = ph.syllable_facts("p", approach)
        got = df.select("p", *[f[c].alias(c) for c in ("n", "classes", "pauses", "corr", "ml", "dig_c", "dig_h")]).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:] == _facts_by_hand(r.p, shorten)


def test_pattern_of_a_line_is_computed_once(spark):
    """Not once more per syllable (in a lambda), nor in a filter below."""
    from queries import all_queries
    for name in ("s05_s07_syllables", "s08_synizesis_pass2", "s08_synizesis_pass5"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "lambda" not in plan and plan.count("eoaiuj._=~") == 1


def test_equal_scans_read_their_lines_once(spark):
    from queries import all_queries
    plan = all_queries()["e05_all_same"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan


def test_steps_of_the_scan_stay_apart(spark):
    """In one method of whole-stage code they would be too long for the JVM to compile."""
    plan = sc.scan_lines(sc.clean_verses(_lines(spark)))._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in plan.splitlines() if "Project" in x]
    assert sum("*(" not in x for x in steps) >= 20
