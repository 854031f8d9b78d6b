"""Rules on forms with known dialects, verdicts on clashing votes."""

from stichos.operators import tokens as tk
from stichos.operators import dialect as di
from stichos.rules import table, votes

FIELDS = "case number gender tense mood voice person stem_class".split()

# rule, form, lemma, pos, properties, expected yes-dialects ("" none)
CASES = [
    ("SW.1", "e(/ws", "e(/ws", "adv", "", "I"), ("SW.1", "a(=s", "e(/ws", "adv", "", "A"),
    ("SW.2", "lew/s", "lao/s", "noun", "", "I"), ("SW.2", "i(/laos", "i)/laos", "adj", "", "A"),
    ("SW.3", "o(/ssos", "o(/sos", "adj", "", "A"), ("SW.3", "o(/sou", "o(/sos", "adj", "", "I"),
    ("SW.4", "a)/mmin", "e)gw/", "pron", "case=dat number=pl", "A"), ("SW.4", "h(mi=n", "e)gw/", "pron", "case=dat number=pl", "I"),
    ("SW.5", "ai)", "ei)", "conj", "", "A"), ("SW.7", "ke", "a)/n", "partic", "", "A"),
    ("SW.9", "e)de/keto", "de/xomai", "verb", "tense=imperf", "A"), ("SW.9", "de/xomai", "de/xomai", "verb", "tense=pres", "I"),
    ("SW.11", "h)/neikan", "fe/rw", "verb", "tense=aor mood=ind", "I"), ("SW.12b", "thnei=", "e)kei=", "adv", "", "A"),
    ("SW.12d", "poka/", "pote/", "adv", "", "A"), ("SW.13", "cei=nos", "ce/nos", "adj", "", "I"),
    ("SW.13", "i)=son", "i)/sos", "adj", "case=acc number=sg", "I"), ("SW.13", "i)/sou", "i)/sos", "adj", "case=gen number=sg", ""),
    ("SW.14", "bo/letai", "bou/lomai", "verb", "", "IH"), ("SW.14", "bou/letai", "bou/lomai", "verb", "", ""),
    ("SW.17", "cu/n", "su/n", "prep", "", "H"), ("SW.17", "su/n", "su/n", "prep", "", "IA"),
    ("SW.21", "i)/a", "ei(=s", "adj", "gender=fem", "AH"), ("SW.21", "ei(=s", "ei(=s", "adj", "gender=masc", ""),
    ("SW.22", "nho/s", "nau=s", "noun", "", "H"), ("SW.23", "pole/essin", "polu/s", "adj", "", "H"), ("SW.24", "pto/lios", "po/lis", "noun", "", "H"),
    ("NE.1a", "gnw/mhs", "gnw/mh", "noun", f"case=gen number=sg gender=fem stem_class={table.LONG_H}", "I"),
    ("NE.1a", "gnw/mas", "gnw/mh", "noun", f"case=gen number=sg gender=fem stem_class={table.LONG_H}", "A"),
    ("NE.1b", "qala/tths", "qa/latta", "noun", f"case=gen number=sg gender=fem stem_class={table.SHORT_A}", "I"),
    ("NE.1b", "qa/latta", "qa/latta", "noun", f"case=nom number=sg gender=fem stem_class={table.SHORT_A}", ""),
    ("NE.2", "poli/tao", "poli/ths", "noun", f"case=gen number=sg gender=masc stem_class={table.LONG_H}", "H"),
    ("NE.3", "polita=n", "poli/ths", "noun", f"case=gen number=pl gender=masc stem_class={table.LONG_H}", "AH"),
    ("NE.4", "basilh=os", "basileu/s", "noun", f"case=gen number=sg stem_class={table.DIGAMMA}", "AH"),
    ("NE.4", "basilei=s", "basileu/s", "noun", f"case=nom number=pl stem_class={table.DIGAMMA}", "IA"),
    ("NE.5", "po/lews", "po/lis", "noun", f"case=gen number=sg stem_class={table.IOTA}", "I"),
    ("NE.5", "poli/essi", "po/lis", "noun", f"case=dat number=pl stem_class={table.IOTA}", "H"),
    ("NE.6", "po/dessi", "pou/s", "noun", "case=dat number=pl", "AH"),
    ("NE.7", "lo/goio", "lo/gos", "noun", f"case=gen number=sg stem_class={table.OMICRON}", "H"),
    ("NE.7", "lo/gois", "lo/gos", "noun", f"case=dat number=pl stem_class={table.OMICRON}", "IA"),
    ("VE.1", "didoi=sqa", "di/dwmi", "verb", "number=sg person=2nd tense=pres mood=ind voice=act", "IH"),
    ("VE.1", "tiqe/asi", "ti/qhmi", "verb", "number=pl person=3rd tense=pres mood=ind voice=act", "A"),
    ("VE.2", "tiqe/atai", "ti/qhmi", "verb", "number=pl person=3rd tense=pres mood=ind voice=mp", "I"),
    ("VE.2", "gegra/fatai", "gra/fw", "verb", "number=pl person=3rd tense=perf mood=ind voice=mp", ""),
    ("VE.3", "tima=tai", "tima/w", "verb", "number=sg person=3rd tense=pres mood=ind voice=mp", "I"),
    ("VE.3", "timh=n", "tima/w", "verb", "tense=pres mood=inf voice=act", "A"),
    ("VE.4", "e)/dosan", "di/dwmi", "verb", "number=pl person=3rd tense=aor mood=ind", "I"),
    ("VE.4", "e)/don", "di/dwmi", "verb", "number=pl person=3rd tense=aor mood=ind", "AH"),
    ("VE.5", "dido/menai", "di/dwmi", "verb", "mood=inf voice=act", "AH"), ("VE.5", "dido/nai", "di/dwmi", "verb", "mood=inf voice=act", "I"),
    ("VE.6", "e)qe/lh|sqa", "e)qe/lw", "verb", "number=sg person=2nd tense=pres mood=subj voice=act", "H"),
    ("VE.6", "oi)=sqa", "oi)=da", "verb", "number=sg person=2nd tense=perf mood=ind voice=act", ""),
    ("NM.1", "paideu/ousin", "paideu/w", "verb", "number=pl person=3rd mood=ind", "IH"),
    ("NM.1", "po/lisin", "po/lis", "noun", "case=dat number=pl", "IH"),
    ("SW.6", "h)/n", "e)a/n", "conj", "", "I"), ("SW.6", "e)a/n", "e)a/n", "conj", "", ""), ("SW.8", "e(/teron", "e(/teros", "adj", "", "I"),
    ("SW.8", "a(/teron", "a(/teros", "adj", "", "A"), ("SW.10", "o)no/mata", "o)/noma", "noun", "", "I"), ("SW.10", "o)/numa", "o)/noma", "noun", "", "A"),
    ("SW.12a", "dh/pou", "dh/pou", "adv", "", "I"), ("SW.12a", "u(po/", "u(po/", "prep", "", ""), ("SW.12c", "po/qen", "po/qen", "adv", "", "I"),
    ("SW.12c", "pro/sqen", "pro/sqen", "adv", "", "I"), ("SW.12c", "pro/sqa", "pro/sqen", "adv", "", "A"), ("SW.15", "i(eroi/", "i(ero/s", "adj", "", "I"),
    ("SW.15", "i(=ros", "i(ero/s", "adj", "", "I"), ("SW.15", "i(arou=", "i(ero/s", "adj", "", "A"), ("SW.16", "kei=non", "e)kei=nos", "adj", "", "I"),
    ("SW.16", "kh=nos", "e)kei=nos", "adj", "", "A"), ("SW.16", "e)kei=non", "e)kei=nos", "adj", "", ""), ("SW.18", "karterou=", "kartero/s", "adj", "", "IA"),
    ("SW.18", "kratero/s", "kratero/s", "adj", "", "H"), ("SW.19", "dhmiorgo/s", "dhmiourgo/s", "noun", "", "I"), ("SW.19", "dhmioergo/s", "dhmiourgo/s", "noun", "", "H"),
    ("SW.20", "i)qei=a", "eu)qu/s", "adj", "", "I"), ("SW.20", "eu)qei=a", "eu)qu/s", "adj", "", "A"),
]


def _prepared(spark):
    rows = []
    for k, (_, form, lemma, pos, props, _) in enumerate(CASES):
        p = dict(x.split("=", 1) for x in props.split())
        rows.append((f"t{k}", 0, form, lemma, pos, *[p.get(f) for f in FIELDS]))
    df = spark.createDataFrame(rows, "token string, parse_no int, form string, lemma string, pos string, "
                               + ", ".join(f"`{f}` string" for f in FIELDS))
    return di.with_parse_count(di.prepare_parses(df))


def test_there_are_42_rules():
    assert len(table.RULES) == 42


def test_every_rule_has_a_case():
    assert {c[0] for c in CASES} == set(table.RULE_NAMES)


def test_rules_on_known_forms(spark):
    got = {(r.token, r.rule): r.code for r in di.rule_votes(_prepared(spark)).collect()}
    for k, (rule, form, *_, want) in enumerate(CASES):
        code = got.get((f"t{k}", rule), votes.NEUTRAL)
        yes = "".join(d[0] for j, d in enumerate(votes.DIALECTS) if code // 3 ** j % 3 == 2)
        assert yes == want, (rule, form, yes, want)


# rules that speak for or against all three dialects; all others weigh Ionic against Aeolic
OF_ALL_THREE = {"SW.14", "SW.17", "SW.18", "SW.19", "SW.21", "SW.22", "SW.23", "SW.24", "NE.3", "NE.4", "NE.5", "NE.6", "NE.7", "VE.1", "VE.4", "VE.5", "VE.6", "NM.1"}
NOTHING_AGAINST = {("NM.1", "po/lisin"), ("SW.15", "i(arou=")}


def test_what_rules_speak_against(spark):
    got = {(r.token, r.rule): r.code for r in di.rule_votes(_prepared(spark)).collect()}
    for k, (rule, form, *_, yes) in enumerate(CASES):
        if not yes or (rule, form) in NOTHING_AGAINST:
            against = ""
        else:
            against = "".join(d for d in ("IAH" if rule in OF_ALL_THREE or "H" in yes else "IA") if d not in yes)
        code = got.get((f"t{k}", rule), votes.NEUTRAL)
        assert "".join(d[0] for j, d in enumerate(votes.DIALECTS) if code // 3 ** j % 3 == 0) == against, (rule, form)


def test_expectations_report_failures(spark):
    expected = spark.createDataFrame([("SW.1", "t0", -1, "Ionic"), ("SW.1", "t0", -1, "Aeolic"), ("SW.14", "t19", -1, "none")],
                                     "rule string, token string, parse_no int, expected string")
    bad = di.check_expectations(_prepared(spark), expected).collect()
    assert [(r.rule, r.token, r.expected) for r in bad] == [("SW.1", "t0", "Aeolic")]


def test_reconcile(spark):
    c = votes.code_of
    rows = [("a", 0, 1, "x", c("I>A")), ("a", 0, 1, "y", c("A>I")),            # both inconsistent, none sure
            ("b", 0, 1, "x", c("I>H")), ("b", 0, 1, "y", c("A>I")),            # Ionic clashes, Aeolic sure after it
            ("d", 0, 1, "x", c("I>H")), ("d", 0, 1, "y", c("H>A"))]            # Ionic sure first, Homeric clashes behind it
    df = spark.createDataFrame(rows, "token string, parse_no int, n_parses int, rule string, code int")
    got = {r.token: (r.v0, r.v1, r.v2) for r in di.reconcile(df).collect()}
    assert got == {"a": (1, 1, 0), "b": (-1, 1, -1), "d": (1, -1, 1)}


def test_max_is_never_below_min(spark):
    out = di.rule_outcomes(di.rule_votes(_prepared(spark))).collect()
    assert out and all(r.dialect_min & ~r.dialect_max == 0 and r.combo_min & ~r.combo_max == 0 and r.possible_min <= r.possible_max for r in out)


def test_codes_round_trip(spark):
    df = spark.range(votes.N_COMBOS).selectExpr("cast(id as int) code")
    v = [votes.decode("code", j) for j in range(3)]
    assert df.filter(votes.encode(v) != df.code).count() == 0


def test_dialect_vector_computes_shared_tables_once(spark, tmp_path):
    """The result is put together from stored tables, none of its branches goes back to the documents; the values are those of the SQL."""
    import duckdb

    from check import rows_of
    from queries import all_oracles, all_queries
    texts = ["mh=nin a)/eide qea\\ te ge", "tis te o(/sos po/lis\nge te", None, "", "te te te"]
    rows = [(k, ("en", "fr")[k % 2], f"src{k % 3}", t) for k, t in enumerate(texts)]
    folder = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").coalesce(1).write.parquet(folder)
    out = all_queries()["f02_dialect_vector"](spark, str(tmp_path))
    assert out.inputFiles() and not [f for f in out.inputFiles() if "documents" in f]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    con.execute("CREATE VIEW benchmark AS SELECT * FROM read_parquet('/root/testdata/sf0.001/benchmark.parquet')")
    got, want = out.toPandas(), con.execute(all_oracles()["f02_dialect_vector"]).df()
    assert len(got) and rows_of(got) == rows_of(want)


def test_types_are_joined_without_copies(spark):
    counts = spark.createDataFrame([("A", 1, "te", 4), ("A", 2, "te", 1), ("A", 2, "xx", 7)], "text_name string, book int, token string, n long")
    outcomes = spark.createDataFrame([("te", 2, 1, 1, 1, 1)], "token string, n_parses int, combo_max int, combo_min int, dialect_max int, dialect_min int")
    out = di.text_counts(counts, outcomes, ["text_name", "book"])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.book, r.n_tokens, r.n_unique, r.n_valid, r.combo_max_0) for r in out.collect()) == [(1, 4, 1, 4, 4), (2, 8, 2, 1, 1)]


def test_spellings_are_counted_before_they_are_standardised(spark):
    words = spark.createDataFrame([("A", w) for w in ("*te", "te", "te", "dw\\ra", "dw/ra", None)], "text_name string, raw string")
    got = sorted(((r.token, r.n) for r in tk.counted(words.filter("raw <> ''"), ["text_name"]).collect()))
    assert got == [("dw/ra", 2), ("te", 3)]


def test_rules_are_compiled(spark):
    """Inside the generator, whose filter is a higher-order one, a rule would be interpreted; in one method with other steps it would not be compiled."""
    fields = [f"if(id > 9, 'x', null) `{f}`" for f in FIELDS]
    parses = spark.range(4).selectExpr("concat('t', id) token", "int(id) parse_no", "if(id > 9, 'x', 'lew/s') form", "if(id = 3, null, 'lao/s') lemma", "if(id > 9, 'x', 'noun') pos", "1 n_parses", *fields)
    votes_ = di.rule_votes(di.prepare_parses(parses.repartition(2)))
    assert {(r.token, r.rule) for r in votes_.collect() if r.rule == "SW.2"} == {(f"t{i}", "SW.2") for i in range(3)}
    for few in (votes_, votes_.select("token", "rule")):
        few.collect()
        plan = few._jdf.queryExecution().executedPlan().toString()
        steps = plan.split("\n")
        assert not any("Generate inline" in s and "CASE WHEN" in s for s in steps)
        ruled = [s for s in steps if "CASE WHEN" in s and "SW.2" in s and "Project [" in s]
        assert ruled and not any("*(" in s.split("Project [")[0] for s in ruled)
