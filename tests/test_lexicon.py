"""Vowel lengths of words by the dictionary, and lines read by two tables at once."""

from pyspark.sql import functions as F

from stichos.functions import phonemes as ph
from stichos.operators import lexicon as lx, scansion as sc

PARSE = "token string, parse_no int, form string, lemma string, pos string, `case` string, number string, gender string, tense string, mood string, voice string, feature string"
# token, lemma, pos, case, gender, tense; entry: pos, ending type, stem, its lengths; lengths and spelling expected
CASES = [
    ("mhte/ri", "mh/thr", "noun", "acc", "fem", None, "noun", "thirdDeclensionConsonantStem", "", "", "lss", ".mhteri"),
    ("mate/ra", "mh/thr", "noun", "acc", "fem", None, "noun", "thirdDeclensionConsonantStem", "m", "", "lss", ".matera"),
    ("xw/ra", "xw/ra", "noun", "nom", "fem", None, "noun", "firstDeclensionEta", "xwr", "l", "ll", "xwr.a"),
    ("dw=ra", "dw=ron", "noun", "nom", "neut", None, "noun", "secondDeclensionOS", "dwr", "l", "ls", "dwr.a"),
    ("e)/lusan", "lu/w", "verb", None, None, "aor", "verb", "thematicVerb", "e)lus", "sl", "sls", "e)lus.an"),
    ("te/qnhka", "qnh/skw", "verb", None, None, "perf", "verb", "thematicVerb", "teqnhk", "sl", "sll", "teqnhk.a"),
    ("oi)=da", "oi)=da", "verb", None, None, "perf", "verb", "verbOida", "", "", "ls", ".voida"),
    ("a)/nac", "a)/nac", "noun", "nom", "masc", None, "noun", "thirdDeclensionConsonantStem", "va)nac", "ss", "ss", "va)nac"),
    ("lao/s", "unknown", "noun", "nom", "masc", None, None, None, None, None, "?s", "lao/s"),
]


def tables(spark):
    forms = spark.createDataFrame([(t, k, t, f"{lemma}#{k}" if lemma not in ("mh/thr",) else lemma, pos, case, "sg", g, tense, "ind" if tense else None, "act" if tense else None, None)
                                   for k, (t, lemma, pos, case, g, tense, *_) in enumerate(CASES)], PARSE)
    entries = [(f"{c[1]}#{k}" if c[1] != "mh/thr" else c[1], c[6], c[7]) for k, c in enumerate(CASES) if c[6]]
    stems = [(f"{c[1]}#{k}" if c[1] != "mh/thr" else c[1], lx.PLAIN_SLOT, k, c[8], c[9]) for k, c in enumerate(CASES) if c[6]]
    return forms, spark.createDataFrame(sorted(set(entries)), "lemma string, entry_pos string, ending_type string"), \
        spark.createDataFrame(stems, "lemma string, slot string, variant_no int, stem string, stem_lengths string")


def test_lengths_of_known_words(spark):
    got = {r.parse_no: (r.lengths, r.spelling) for r in lx.parse_lengths(*tables(spark)).collect()}
    assert len(got) == len(CASES)
    for k in range(9):
        assert got[k] == CASES[k][-2:], CASES[k]


def test_both_readings_at_once(spark):
    lines = spark.createDataFrame([("A", 1, "xw/ra te dw=ra "), ("A", 2, "tei "), ("A", 3, ""), ("A", 4, None), ("A", 5, "xw/ra "), ("A", 5, "xw/ra "), ("A", 5, "other ")],
                                  "text_name string, line int, text string")
    forms, entries, stems = tables(spark)
    clitic = spark.createDataFrame([("te", 0, "te", "te", "partic", None, None, None, None, None, None, None)], PARSE)
    words = lx.reading_tokens(forms.unionByName(clitic), entries, stems)
    out = sc.line_readings(lines, words, ["text_name", "line"], {"native": ("native", ph.NATIVE), "student": ("student", ph.STUDENT)})
    got = sorted(((r.line, r.text, r.native, r.student) for r in out.collect()), key=str)
    assert out.columns == ["text_name", "line", "text", "native", "student"]
    assert [(line, text) for line, text, *_ in got] == sorted([(1, "xw/ra te dw=ra "), (2, "tei "), (3, ""), (4, None), (5, "xw/ra "), (5, "xw/ra "), (5, "other ")], key=str)
    by = {(line, text): rest for line, text, *rest in got}
    assert by[1, "xw/ra te dw=ra "][1] == "xw/ra.te dw=ra "
    assert by[1, "xw/ra te dw=ra "][0].replace(".", "") == "xw_ra_te^ dw_ra^ "
    assert by[2, "tei "] == ["t.ei_ ", "tei "] and by[3, ""] == [None, None] and by[4, None] == [None, None]
    assert by[5, "xw/ra "][1] == "xw/ra " and by[5, "other "][1] == "other "


def test_a_line_is_shuffled_twice(spark):
    lines = spark.createDataFrame([("A", k, "te " * 5) for k in range(50)], "text_name string, line int, text string")
    tokens = spark.createDataFrame([("te", "te", True, False)], "token string, sound string, enclitic boolean, proclitic boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sc.line_sounds(lines, tokens, ["text_name", "line"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32MB")
    own = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(own) == 3                                              # words to types, types to words, words back to their lines


def test_words_are_sent_once_per_chunk(spark, monkeypatch):
    lines = spark.createDataFrame([("A", k, "te te xw/ra te ") for k in range(1000)], "text_name string, line int, text string").coalesce(1)
    rows = sc._chunks(lines, "text")
    assert rows.filter("raw IS NULL").count() == 1000 and rows.filter("raw IS NOT NULL").count() == 2
    # many chunks give the same lines
    tokens = spark.createDataFrame([("te", "te", True, False), ("xw/ra", "xw_ra", False, True)], "token string, sound string, enclitic boolean, proclitic boolean")
    monkeypatch.setattr(sc, "CHUNK_LINES", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
    try:
        assert sc._chunks(lines, "text").filter("raw IS NOT NULL").select("chunk").distinct().count() == 9
        got = sc.line_sounds(lines, tokens, ["text_name", "line"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r.line for r in got) == list(range(1000)) and {r.sound_text for r in got} == {"te.te xw_ra.te "}


def test_clitics_on_words_without_sound():
    assert sc._glued([("a", False, False), ("", False, False), ("b", True, False)]) == "a.b "
    assert sc._glued([("", False, False), ("b", True, True)]) == ".b "
    assert sc._glued([("a", False, True), ("b", True, False), ("c", False, False)]) == "a.b c "


def test_split_ending(spark):
    df = spark.createDataFrame([("oi)i+w", "oi)"), ("a)/nra", "a)"), ("lo/gos", "log"), ("lo/gos", "vlog"), ("lo/gos", "xog"), ("gero/nti", "geront")], "token string, stem string")
    got = {(r.token, r.stem): r.ending for r in lx.split_ending(df).collect()}
    assert got["lo/gos", "log"] == "os" and got["lo/gos", "vlog"] == "os" and got["lo/gos", "xog"] is None and got["gero/nti", "geront"] == "i"


def test_clitic_tests(spark):
    rows = [("e(/", "eu(=", None, None), ("e(/", "xx", None, None), ("sfei=s", "sfas", None, None), ("a)/ra1", "r(a", None, None), ("a)/ra", "r(a", None, None), ("phmi/", "phsi/", "pres", "ind"),
            ("phmi/", "ph/|s", "pres", "ind"), ("ei)mi/", "e)sti/", "pres", "ind"), ("ei)mi/", "ei)si/", "pres", "ind"), ("pote/2", "x", None, None), ("pote/3", "x", None, None), ("x", "moi//", None, None)]
    df = spark.createDataFrame(rows, "lemma string, form string, tense string, mood string")
    got = [r.e for r in df.select(lx.is_enclitic_parse().alias("e")).collect()]
    assert got == [True, False, True, True, False, True, False, True, False, True, False, True]
    pro = spark.createDataFrame([("ou)12", "x"), ("ou)", "x"), ("ou)x", "x"), ("ei)2", "x"), ("o(", "ai("), ("o(", "tou="), ("w(s", "x")], "lemma string, form string")
    assert [r.p for r in pro.select(lx.is_proclitic_parse().alias("p")).collect()] == [True, True, False, True, True, False, True]
