"""X-*, S-2 ... S-4, S-11: lexicon joins, classification, vowel lengths.

A small morphology is derived from the tokens of the documents: every distinct token has
up to three parses whose properties follow from its letters.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from queries import common as c, q_scan
from queries.q_corpus import SQL_BENCH, benchmark_tokens
from stichos.functions import phonemes as ph
from stichos.operators import entries as en, evaluate as ev, lexicon as lx, scansion as sc
from stichos.rules import references as rf, table as tb

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# ---- morphology from tokens ------------------------------------------------------------------------

LEMMAS = ["tis", "ge", "te", "o(", "ei)s", "ou)", "lao/s", "o(/sos", "po/lis", "di/dwmi", "tima/w", "basileu/s",
          "*za/kunqos", "ske/parnon", "ei)mi/", "polu/s", "lo/gos", "gnw/mh", "oi)=da", "ei(=s", "de/xomai", "su/n",
          "e)kei=", "nau=s", "kratero/s", "i(ero/s", "o(/s", "e)gw/", "fe/rw", "po/te"]
POS = ["noun", "adj", "verb", "part", "pron", "adv"]
CASES = ["nom", "gen", "dat", "acc", "voc"]
NUMBERS = ["sg", "pl", "dual"]
GENDERS = ["masc", "fem", "neut"]
TENSES = ["pres", "imperf", "aor", "fut", "perf", "plup", "futperf"]
MOODS = ["ind", "subj", "opt", "inf", "imperat"]
VOICES = ["act", "mp", "mid", "pass"]
PERSONS = ["1st", "2nd", "3rd"]
CLASSES = ["type_1_2_os/a/on_adjective", "type_2nd_decl_adjective", "type_us_eia_u_adjective", "type_eis_essa_en_adjective",
           "alpha_stem_-h", "alpha_stem_short_-a", "alpha_stem_eir_-a", "alpha_stem_eir_short_-a", "digamma_stem", "iota_stem",
           "omicron_stem", "no_special_type"]
ENDS = ["", "os", "h", "hs", "as", "ou", "oio", "eos", "ei", "essi", "sin", "atai", "ntai", "menai", "san", "hn", "wn", "w"]
_PARTS = (("lemma", LEMMAS, False), ("pos", POS, False), ("case", CASES, True), ("number", NUMBERS, True), ("gender", GENDERS, True),
          ("tense", TENSES, True), ("mood", MOODS, True), ("voice", VOICES, True), ("person", PERSONS, True), ("stem_class", CLASSES, False))
TAGS = ["ionic", "epic ionic", "aeolic", "epic", "attic"]


def vocabulary(spark, sf):
    return c.token_counts(spark, sf, [])


# one word in sixteen, chosen by a hash, has no parse
HAS_PARSES = "substr(md5(token), 1, 1) <> '0'"


def part(k):
    """A number 0 ... 65535 from the md5 of token and parse; k chooses which."""
    return F.conv(F.substr(F.md5(F.concat_ws("#", "token", "parse_no", F.lit(str(k))).cast("binary")), F.lit(1), F.lit(4)), 16, 10).cast("int")


def chosen(values, k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), part(k) % len(values) + 1)


def parses(spark, sf, words=None):
    """One to three parses per distinct token; one property in eight is missing. `words`: the vocabulary, where it is at hand."""
    v = (vocabulary(spark, sf) if words is None else words).filter(HAS_PARSES)
    p = v.select("token", F.explode(F.sequence(F.lit(0), (F.length("token") + F.ascii("token")) % 3)).alias("parse_no"))
    return p.select("token", "parse_no", F.concat("token", chosen(ENDS, 90)).alias("form"), *[
        (F.when(part(50 + k) % 8 != 0, chosen(vals, k)) if gaps else chosen(vals, k)).alias(name)
        for k, (name, vals, gaps) in enumerate(_PARTS)],
        F.when(part(91) % 3 != 0, chosen(TAGS, 92)).alias("dialect"), F.when(part(93) % 5 == 0, "unaugmented").alias("feature"))


def _list(values):
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_part(k):
    return f"CAST('0x' || left(md5(token || '#' || parse_no || '#{k}'), 4) AS INTEGER)"


def sql_chosen(values, k):
    return f"({_list(values)})[{sql_part(k)} % {len(values)} + 1]"


SQL_PARSES = SQL_BENCH + f""",
vocab AS (SELECT token, count(*) AS n FROM std GROUP BY token),
ab AS (SELECT token, length(token) AS a, ascii(token) AS b, ascii(right(token, 1)) AS d FROM vocab WHERE substr(md5(token), 1, 1) <> '0'),
pn AS (SELECT token, CAST(unnest(range(0, (a + b) % 3 + 1)) AS INTEGER) AS parse_no FROM ab),
parses AS (SELECT token, parse_no, token || {sql_chosen(ENDS, 90)} AS form, {", ".join(
    (f"CASE WHEN {sql_part(50 + k)} % 8 <> 0 THEN {sql_chosen(vals, k)} END" if gaps else sql_chosen(vals, k)) + f' AS "{name}"'
    for k, (name, vals, gaps) in enumerate(_PARTS))},
  CASE WHEN {sql_part(91)} % 3 <> 0 THEN {sql_chosen(TAGS, 92)} END AS dialect, CASE WHEN {sql_part(93)} % 5 = 0 THEN 'unaugmented' END AS feature FROM pn)"""


@query("x01_lookup_parses", f"""WITH {SQL_PARSES}
SELECT text_name, CAST(sum(v.n * coalesce(k, 1)) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN k IS NULL THEN v.n ELSE 0 END) AS BIGINT) AS n_invalid
FROM (SELECT text_name, token, count(*) AS n FROM std GROUP BY ALL) v LEFT JOIN (SELECT token, count(*) AS k FROM parses GROUP BY token) p USING (token) GROUP BY ALL""")
def lookup(spark, sf):
    t = c.token_counts(spark, sf, ["text_name"])
    j = lx.lookup_parses(t, parses(spark, sf))
    return j.groupBy("text_name").agg(F.sum("n").alias("n_rows"), F.sum(F.when(~F.col("valid"), F.col("n")).otherwise(0)).alias("n_invalid"))


@query("x02_forms_in_vocabulary", f"WITH {SQL_PARSES} SELECT token, parse_no, lemma FROM parses WHERE token IN (SELECT token FROM bstd)")
def in_vocab(spark, sf):
    return lx.forms_in_vocabulary(parses(spark, sf), benchmark_tokens(spark, sf)).select("token", "parse_no", "lemma")


@query("x03_lemma_pos", f"WITH {SQL_PARSES} SELECT lemma, array_to_string(list_sort(list(DISTINCT pos)), ',') AS pos_set FROM parses GROUP BY lemma")
def lemma_pos(spark, sf):
    return lx.lemma_pos(parses(spark, sf)).select("lemma", F.array_join("pos_set", ",").alias("pos_set"))


# Stem classes: lemmas of every block made of tokens, with the forms that their probes look for, some left out and some in another case
STEMS = [("h", "noun"), ("h/", "noun"), ("ia", "noun"), ("ra/", "noun"), ("va", "noun"), ("hs", "noun"), ("h/s", "noun"), ("ias", "noun"), ("ra/s", "noun"), ("eu/s", "noun"), ("is", "noun"), ("i/s", "noun"),
         ("os", "adj"), ("o/s", "adj"), ("u/s", "adj"), ("o/eis", "adj"), ("os", "noun"), ("o/s", "noun"), ("us", "noun"), ("os", "verb"), ("eis", "adj"), ("ei=ra", "noun"), ("a/stria", "noun")]
# block, what the lemma ends in, letters cut, accent, ending, case, number, gender, class
_PROBE_ROWS = """pb(no, block, needs, cut, accent, ending, c, n, g, cls) AS (VALUES
(0, 1, 'h', 1, '-', 'hs', 'gen', 'sg', 'fem', 'alpha_stem_-h'), (1, 1, 'h/', 2, '-', 'h=s', 'gen', 'sg', 'fem', 'alpha_stem_-h'),
(2, 2, 'a', 1, '-', 'ai', 'nom', 'pl', 'fem', 'eir'), (3, 2, 'a', 1, 'moves', 'as', 'gen', 'sg', 'fem', 'eir'), (4, 2, 'a/', 2, '-', 'ai/', 'nom', 'pl', 'fem', 'eir'), (5, 2, 'a/', 2, '-', 'a=s', 'gen', 'sg', 'fem', 'eir'),
(6, 3, '', 1, '-', 'ai', 'nom', 'pl', 'fem', 'alpha_stem_short_-a'), (7, 3, '', 1, 'moves', 'as', 'gen', 'sg', 'fem', 'alpha_stem_short_-a'),
(8, 4, 'hs', 2, '-', 'ou', 'gen', 'sg', 'masc', 'alpha_stem_-h'), (9, 4, 'hs', 2, '-', 'hn', 'acc', 'sg', 'masc', 'alpha_stem_-h'), (10, 4, 'h/s', 3, '-', 'ou=', 'gen', 'sg', 'masc', 'alpha_stem_-h'), (11, 4, 'h/s', 3, '-', 'h/n', 'acc', 'sg', 'masc', 'alpha_stem_-h'),
(12, 5, 'as', 2, '-', 'ou', 'gen', 'sg', 'masc', 'LONG_A'), (13, 5, 'as', 2, '-', 'hn', 'acc', 'sg', 'masc', 'LONG_A'), (14, 5, 'a/s', 3, '-', 'ou=', 'gen', 'sg', 'masc', 'LONG_A'), (15, 5, 'a/s', 3, '-', 'h/n', 'acc', 'sg', 'masc', 'LONG_A'),
(16, 6, '', 4, '-', 'e/ws', 'gen', 'sg', NULL, 'digamma_stem'), (17, 7, 'is', 2, '-', 'ews', 'gen', 'sg', NULL, 'iota_stem'), (18, 7, 'i/s', 3, '-', 'e/ws', 'gen', 'sg', NULL, 'iota_stem'),
(19, 8, 'os', 2, '-', 'ai', 'nom', 'pl', 'fem', 'ADJ_3'), (20, 8, 'os', 2, 'moves', 'hs', 'gen', 'sg', 'fem', 'ADJ_3'), (21, 8, 'os', 2, '-', 'oi', 'nom', 'pl', NULL, 'ADJ_2'), (22, 8, 'os', 2, 'moves', 'ou', 'gen', 'sg', NULL, 'ADJ_2'),
(23, 8, 'o/s', 3, '-', 'ai/', 'nom', 'pl', 'fem', 'ADJ_3'), (24, 8, 'o/s', 3, '-', 'h=s', 'gen', 'sg', 'fem', 'ADJ_3'), (25, 8, 'o/s', 3, '-', 'oi/', 'nom', 'pl', NULL, 'ADJ_2'), (26, 8, 'o/s', 3, '-', 'ou=', 'gen', 'sg', NULL, 'ADJ_2'),
(27, 9, '', 3, '-', 'ei=a', 'nom', 'sg', 'fem', 'ADJ_US'), (28, 10, '', 3, 'drops', 'e/ssas', 'gen', 'sg', 'fem', 'ADJ_EIS'),
(29, 11, 'os', 2, 'moves', 'ou', 'gen', 'sg', NULL, 'OMICRON'), (30, 11, 'os', 2, '-', 'ous', 'gen', 'sg', NULL, 'SIGMA'), (31, 11, 'o/s', 3, '-', 'ou=', 'gen', 'sg', NULL, 'OMICRON'), (32, 11, 'o/s', 3, '-', 'ou=s', 'gen', 'sg', NULL, 'SIGMA'))"""
for _word, _class in (("LONG_A", tb.LONG_A), ("ADJ_3", tb.ADJ_3), ("ADJ_2", tb.ADJ_2), ("ADJ_US", tb.ADJ_US), ("ADJ_EIS", tb.ADJ_EIS), ("OMICRON", tb.OMICRON), ("SIGMA", tb.SIGMA)):
    _PROBE_ROWS = _PROBE_ROWS.replace(f"'{_word}'", f"'{_class}'")
# the forms that the data hold: letters cut off the lemma, what is added, case, number, gender
FORMS = [(1, "hs", "gen", "sg", "fem"), (2, "h=s", "gen", "sg", "fem"), (1, "ai", "nom", "pl", "fem"), (1, "as", "gen", "sg", "fem"), (2, "ai/", "nom", "pl", "fem"), (2, "a=s", "gen", "sg", "fem"), (2, "ou", "gen", "sg", "masc"),
         (2, "hn", "acc", "sg", "masc"), (3, "ou=", "gen", "sg", "masc"), (3, "h/n", "acc", "sg", "masc"), (4, "e/ws", "gen", "sg", "masc"), (2, "ews", "gen", "sg", "fem"), (3, "e/ws", "gen", "sg", "fem"), (2, "ai", "nom", "pl", "fem"),
         (2, "hs", "gen", "sg", "fem"), (2, "oi", "nom", "pl", "masc"), (3, "ai/", "nom", "pl", "fem"), (3, "h=s", "gen", "sg", "fem"), (3, "oi/", "nom", "pl", "masc"), (3, "ei=a", "nom", "sg", "fem"), (3, "e/ssas", "gen", "sg", "fem"),
         (2, "ous", "gen", "sg", "neut"), (3, "ou=s", "gen", "sg", "neut")]
_ROWS = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in (k, *r)) + ")" for k, r in enumerate(rows))
_CLEAN_SQL = c.sql_strip("lemma")
_STEM_SQL = c.SQL_TOKENS + f""",
sx(i, tail, pos) AS (VALUES {_ROWS(STEMS)}), fx(j, cut, added, c, n, g) AS (VALUES {_ROWS(FORMS)}), {_PROBE_ROWS},
bs AS (SELECT DISTINCT token AS t FROM std WHERE length(token) > 1),
lm AS (SELECT t, t || tail AS lemma, pos, md5(t) AS h FROM bs JOIN sx ON i = CAST('0x' || left(md5(t), 6) AS INTEGER) % {len(STEMS)}),
ff AS (SELECT lemma, pos, left(b, CAST(greatest(length(b) - cut, 0) AS INTEGER)) || added AS token, CASE WHEN CAST('0x' || left(md5(lemma || '#c' || j), 4) AS INTEGER) % 4 = 0 THEN 'dat' ELSE c END AS c, n, g FROM (
  SELECT *, CASE WHEN CAST('0x' || left(md5(lemma || '#a'), 4) AS INTEGER) % 2 = 0 THEN CASE WHEN contains(lemma, '/') THEN regexp_replace(replace(lemma, '/', ''), '^(.*[aeiouwh])([^aeiouwh]*)', '\\1/\\2') ELSE replace(lemma, '=', '/') END ELSE lemma END AS b FROM lm, fx)
  WHERE CAST('0x' || left(md5(lemma || '#' || j), 4) AS INTEGER) % 3 = 0),
frm AS (SELECT * FROM ff UNION ALL SELECT lemma, pos, lemma, 'nom', 'sg', 'masc' FROM lm)"""


def _stem_forms(spark, sf):
    number = lambda text, digits: F.conv(F.left(F.md5(text.cast("binary")), F.lit(digits)), 16, 10).cast("int")
    t = c.tokens(spark, sf).select("token").distinct().filter(F.length("token") > 1)
    kind = number(F.col("token"), 6) % len(STEMS)
    lm = t.select(F.concat("token", F.element_at(F.array(*[F.lit(x) for x, _ in STEMS]), kind + 1)).alias("lemma"), F.element_at(F.array(*[F.lit(x) for _, x in STEMS]), kind + 1).alias("pos"))
    based = lm.withColumn("b", F.when(number(F.concat("lemma", F.lit("#a")), 4) % 2 == 0, lx.accent_forward("lemma")).otherwise(F.col("lemma")))

    def cell(j, cut, added, case, num, gen):
        given = number(F.concat("lemma", F.lit(f"#c{j}")), 4) % 4 == 0
        return F.when(number(F.concat("lemma", F.lit(f"#{j}")), 4) % 3 == 0, F.struct(
            F.concat(F.substr("b", F.lit(1), F.length("b") - cut), F.lit(added)).alias("token"), F.when(given, "dat").otherwise(case).alias("case"), F.lit(num).alias("number"), F.lit(gen).alias("gender")))

    plain = F.struct(F.col("lemma").alias("token"), F.lit("nom").alias("case"), F.lit("sg").alias("number"), F.lit("masc").alias("gender"))
    cells = F.array(*[cell(j, *r) for j, r in enumerate(FORMS)], plain)
    return based.select("lemma", "pos", F.inline(F.filter(cells, lambda x: x.isNotNull())))


_FORWARD = "CASE WHEN contains({0}, '/') THEN regexp_replace(replace({0}, '/', ''), '^(.*[aeiouwh])([^aeiouwh]*)', '\\1/\\2') ELSE replace({0}, '=', '/') END"


@query("x04_stem_classes", f"""WITH {_STEM_SQL},
le AS (SELECT lemma, list(DISTINCT pos) AS ps FROM frm GROUP BY lemma),
l1 AS (SELECT lemma, ps, regexp_replace({c.sql_decap_token('lemma')}, '[0-9]', '', 'g') AS plain, {c.sql_decap_token('lemma')} AS low, {_CLEAN_SQL} AS clean, regexp_replace(lemma, '[0-9]', '', 'g') AS bare FROM le),
l2 AS (SELECT *, CASE WHEN right(clean, 1) = 'h' AND list_contains(ps, 'noun') THEN 1 WHEN right(clean, 2) IN ('ra', 'ia', 'ea') AND list_contains(ps, 'noun') THEN 2 WHEN right(clean, 1) = 'a' AND list_contains(ps, 'noun') THEN 3
  WHEN right(clean, 2) = 'hs' AND list_contains(ps, 'noun') THEN 4 WHEN right(clean, 3) IN ('ras', 'ias', 'eas') AND list_contains(ps, 'noun') THEN 5 WHEN right(clean, 3) = 'eus' AND list_contains(ps, 'noun') THEN 6
  WHEN right(clean, 2) = 'is' AND list_contains(ps, 'noun') THEN 7 WHEN right(clean, 2) = 'os' AND list_contains(ps, 'adj') THEN 8 WHEN right(lemma, 3) = 'u/s' AND list_contains(ps, 'adj') THEN 9
  WHEN right(clean, 3) = 'eis' AND list_contains(ps, 'adj') THEN 10 WHEN right(clean, 2) = 'os' AND list_contains(ps, 'noun') THEN 11 END AS block FROM l1),
tr AS (SELECT l2.*, pb.*, left(CASE WHEN pb.block = 6 THEN low ELSE plain END, CAST(greatest(length(CASE WHEN pb.block = 6 THEN low ELSE plain END) - cut, 0) AS INTEGER)) AS stem FROM l2 JOIN pb ON pb.block = l2.block AND right(bare, length(needs)) = needs),
t2 AS (SELECT lemma, no, cls, c, n, g, CASE accent WHEN 'moves' THEN {_FORWARD.format('stem')} WHEN 'drops' THEN translate(stem, '*/', '') ELSE stem END || ending AS form FROM tr),
hit AS (SELECT t2.lemma, arg_min(cls, no) AS cls FROM t2 JOIN frm f ON f.lemma = t2.lemma AND f.token = t2.form AND f.c = t2.c AND f.n = t2.n AND (t2.g IS NULL OR t2.g = f.g) GROUP BY t2.lemma),
sa AS (SELECT lemma, regexp_extract_all(regexp_replace(translate({c.sql_decap_token('lemma')}, 'bcdfgjklmnpqrstvxyz', ''), '([aeiouhwj])\\+', '.\\1', 'g'), '(?:[aeou]i|[aoehw]u|[a-z])[^a-z.]*') AS p FROM le)
SELECT le.lemma, coalesce(CASE WHEN cls = 'eir' THEN CASE WHEN coalesce(contains(p[-2], '='), false) OR coalesce(contains(p[-3], '/'), false) THEN '{tb.EIR_SHORT_A}' ELSE '{tb.LONG_A}' END ELSE cls END, '{tb.NO_CLASS}') AS stem_class
FROM le LEFT JOIN hit USING (lemma) LEFT JOIN sa USING (lemma)""")
def stem_classes(spark, sf):
    return lx.stem_classes(_stem_forms(spark, sf))


@query("x04a_x04b_accents", f"""WITH {c.SQL_TOKENS},
w AS (SELECT DISTINCT translate(token, '/=', '') AS t FROM std), a AS (SELECT left(t, length(t) // 2) || '/' || substr(t, length(t) // 2 + 1) AS s FROM w UNION SELECT t || '=' FROM w UNION SELECT t FROM w),
v AS (SELECT s, regexp_extract_all(regexp_replace(translate(s, 'bcdfgjklmnpqrstvxyz', ''), '([aeiouhwj])\\+', '.\\1', 'g'), '(?:[aeou]i|[aoehw]u|[a-z])[^a-z.]*') AS p FROM a)
SELECT s, coalesce(contains(p[-2], '='), false) OR coalesce(contains(p[-3], '/'), false) AS short_alpha,
  CASE WHEN contains(s, '/') THEN regexp_replace(replace(s, '/', ''), '^(.*[aeiouwh])([^aeiouwh]*)', '\\1/\\2') ELSE replace(s, '=', '/') END AS forward FROM v""")
def accents(spark, sf):
    w = c.tokens(spark, sf).select(F.translate("token", "/=", "").alias("t")).distinct()
    half = F.floor(F.length("t") / 2).cast("int")
    s = w.select(F.explode(F.array(F.concat(F.left("t", half), F.lit("/"), F.substr("t", half + 1)), F.concat("t", F.lit("=")), "t")).alias("s")).distinct()
    s = s.withColumn("s", F.lower("s")).distinct()
    return s.select("s", lx.short_alpha_by_accent("s").alias("short_alpha"), lx.accent_forward("s").alias("forward"))


# the clitic tests written out for SQL
_ISENC = r"""(lemma IN ('tis', 'pou/', 'pou/2', 'poqi', 'ph', 'poi', 'poqen', 'pote/', 'pote/2', 'pw', 'pw2', 'pws', 'ge', 'te', 'toi', 'toi2', 'pe/r', 'qh/n')
 OR form IN ('mou', 'mou=', 'moi/', 'moi//', 'me', 'me/', 'sou', 'sou=', 'soi', 'soi/', 'se', 'se/', 'e(', 'e(/', 'sfisi', 'sfi/si', 'meu', 'meu=', 'seo', 'se/o', 'seu', 'seu=', 'toi', 'toi/', 'te/', 'tu/',
   'e(/o', 'min', 'mi/n', 'nin', 'ni/n', 'sfi', 'sfi/', 'sfin', 'sfi/n', 'sfwe', 'sfwe/', 'sfwin', 'sfwi/n', 'sfe/as', 'sfea', 'sfe/a', 'nu', 'nu/', 'nun', 'nu/n', 'ke', 'ke/', 'ken', 'ke/n')
 OR (lemma = 'e(/' AND form IN ('ou(=', 'oi(=', 'e(/o', 'e(o', 'eu(=', 'eu(', 'e(/qen', 'e(qen')) OR (lemma = 'sfei=s' AND form IN ('sfe/', 'sfe', 'sfe/wn', 'sfewn', 'sfa/s', 'sfa=s', 'sfas'))
 OR (regexp_full_match(lemma, 'a\)/ra.') AND form IN ('r(a/', 'r(a')) OR coalesce(lemma = 'ei)mi/' AND tense = 'pres' AND mood = 'ind' AND left(form, 3) <> 'ei)', false)
 OR coalesce(lemma = 'phmi/' AND tense = 'pres' AND mood = 'ind' AND form NOT IN ('ph/|s', 'ph=|s'), false))"""
_ISPRO = r"""((lemma = 'o(' AND (left(form, 1) IN ('o', 'h') OR left(form, 2) = 'ai')) OR lemma IN ('ei)s', 'e)k', 'e)c', 'ei)', 'ei)2', 'w(s') OR regexp_full_match(lemma, 'ou\)[0-9]*'))"""
CLITIC_LEMMAS = ["e(/", "sfei=s", "a)/ra1", "a)/ra", "phmi/", "ei)mi/", "pw2", "pote/2", "pote/22", "ou)12", "ei)2", "ei)s", "o("]
CLITIC_FORMS = ["ou(=", "e(/o", "e(qen", "sfe/wn", "sfas", "r(a", "r(a/", "ph/|s", "phsi/", "ei)si/", "e)sti/", "nu/n", "moi//", "mou=", "sfisi", "ai(", "o(", "tou", "xa/ra"]


def clitic_parses(spark, sf):
    """Half of the parses get a lemma and a form of the clitics."""
    odd = part(95) % 2 == 0
    return parses(spark, sf).withColumns({"lemma": F.when(odd, chosen(CLITIC_LEMMAS, 96)).otherwise(F.col("lemma")),
                                          "form": F.when(odd, chosen(CLITIC_FORMS, 97)).otherwise(F.col("form"))})


_CLITIC_PARSES = f"""cp AS (SELECT * REPLACE (CASE WHEN {sql_part(95)} % 2 = 0 THEN {sql_chosen(CLITIC_LEMMAS, 96)} ELSE lemma END AS lemma,
  CASE WHEN {sql_part(95)} % 2 = 0 THEN {sql_chosen(CLITIC_FORMS, 97)} ELSE form END AS form) FROM parses)"""


@query("x05_x08_clitics", f"""WITH {SQL_PARSES}, {_CLITIC_PARSES}
SELECT token, bool_and({_ISENC}) AS enclitic, bool_and({_ISPRO}) AS proclitic, CASE WHEN min(lemma) = max(lemma) THEN max(lemma) END AS only_lemma
FROM cp GROUP BY token""")
def clitics(spark, sf):
    return lx.token_facts(clitic_parses(spark, sf))


@query("x05_x06_clitic_parses", f"""WITH {SQL_PARSES}, {_CLITIC_PARSES}
SELECT lemma, form, {_ISENC} AS enclitic, {_ISPRO} AS proclitic, count(*) AS n FROM cp GROUP BY ALL""")
def clitic_tests(spark, sf):
    p = clitic_parses(spark, sf)
    return p.groupBy("lemma", "form", lx.is_enclitic_parse().alias("enclitic"), lx.is_proclitic_parse().alias("proclitic")).agg(F.count("*").alias("n"))


@query("s03_s04_sound_text", f"""WITH {SQL_PARSES},
facts AS (SELECT token, bool_and({_ISENC}) AS enc, bool_and({_ISPRO}) AS pro, CASE WHEN min(lemma) = max(lemma) THEN max(lemma) END AS only_lemma FROM parses GROUP BY token),
wl AS (SELECT doc_id, line, unnest(string_split(clean, ' ')) AS raw, generate_subscripts(string_split(clean, ' '), 1) AS pos FROM cl),
tk2 AS (SELECT * FROM wl WHERE raw <> ''),
st2 AS (WITH {c.sql_standardize_ctes('tk2', 'raw', 'doc_id, line, pos, raw')} SELECT * FROM std),
wd AS (SELECT doc_id, line, pos, CASE WHEN facts.token IS NULL THEN raw WHEN only_lemma IN ('*za/kunqos', '*ze/leia') AND left(st2.token, 1) = 'z' THEN 'z^' || substr(st2.token, 2)
   WHEN only_lemma IN ('ske/parnon', '*skama/ndrios', '*ska/mandros') AND left(st2.token, 2) = 'sk' THEN 's~' || substr(st2.token, 3) ELSE st2.token END AS sound,
   coalesce(enc, false) AS enc, coalesce(pro, false) AS pro FROM st2 LEFT JOIN facts ON st2.token = facts.token),
jn AS (SELECT *, lead(enc) OVER (PARTITION BY doc_id, line ORDER BY pos) AS next_enc FROM wd)
SELECT doc_id, line, string_agg(sound || CASE WHEN NOT enc AND pro THEN '.' WHEN coalesce(next_enc, false) THEN '.' ELSE ' ' END, '' ORDER BY pos) AS sound_text FROM jn GROUP BY ALL""")
def sound_text(spark, sf):
    lines = sc.clean_verses(c.doc_lines(spark, sf)).select("doc_id", F.col("line").cast("long").alias("line"), "text")
    tokens = lx.student_tokens(parses(spark, sf))
    return sc.line_sounds(lines, tokens, ["doc_id", "line"]).filter("sound_text IS NOT NULL").select("doc_id", "line", "sound_text")


# ---- entries ----------------------------------------------------------------------------------------

@query("x09_x10_entry_text", r"""SELECT page_id, replace(replace(regexp_replace(regexp_replace(
   CASE WHEN contains(h, '<sense') THEN left(h, strpos(h, '<sense') - 1) || '$$' || substr(h, strpos(h, '<sense')) ELSE h END,
   '<[^>]*>', '', 'g'), ',([^\s])', ', \1', 'g'), '&#65288;', '('), '&#65289;', ')') AS core,
  replace(translate(string_split(url, ' ')[1], ',.:', ''), '-', '') || CASE WHEN translate(string_split(url, ' ')[1], ',.:', '') LIKE '%-' THEN '-' ELSE '' END AS headword
FROM (SELECT page_id, url, replace(html, '<h1', '<sense') AS h FROM pages)""")
def entry_text(spark, sf):
    p = c.load(spark, sf, "pages")
    return p.select("page_id", en.core_text(F.replace("html", F.lit("<h1"), F.lit("<sense"))).alias("core"), en.headword("url").alias("headword"))


# entries are the lines of the documents: first word, rest, and now and then a sense mark
_ENT = c.SQL_LINES + """,
ent AS (SELECT doc_id, line, CASE WHEN line % 3 = 0 THEN regexp_replace(text, ' ', ' $$') WHEN line % 3 = 1 THEN regexp_replace(text, ',', ', o(, $$') ELSE replace(text, '.', ':') END AS core FROM lines)"""


def _entries(spark, sf):
    t = F.col("text")
    core = (F.when(F.col("line") % 3 == 0, F.regexp_replace(t, "(?s)^(.*?) ", "$1 \\$\\$"))
            .when(F.col("line") % 3 == 1, F.regexp_replace(t, "(?s)^(.*?),", "$1, o(, \\$\\$")).otherwise(F.replace(t, F.lit("."), F.lit(":"))))
    return c.doc_lines(spark, sf).select("doc_id", F.col("line").cast("long").alias("line"), core.alias("core"))


def _head_sql():
    e = [f"WHEN regexp_matches(core, '{p}') THEN regexp_extract(core, '{p}', 0)" for p in en.HEAD_ENDS]
    after = "(?s)^.*?" + en.GENDER_AFTER_SENSE
    return (f"CASE WHEN regexp_matches(core, '{en.VERB_HEAD}') AND contains(core, ':—') THEN string_split(core, ':—')[1] "
            f"WHEN regexp_matches(core, '{en.VERB_HEAD}') AND contains(core, ':&#8212;') THEN string_split(core, ':&#8212;')[1] "
            + " ".join(e) + f" WHEN regexp_matches(core, '{en.GENDER_AFTER_SENSE}') THEN regexp_extract(core, '{after}', 0) "
            r"WHEN regexp_matches(core, '^\S*:') THEN string_split(core, ':')[1] WHEN contains(core, '$$') THEN string_split(core, '$$')[1] ELSE string_split(core, ':')[1] END")


@query("x11_grammar_head", f"WITH {_ENT} SELECT doc_id, line, {_head_sql()} AS head FROM ent")
def head(spark, sf):
    return _entries(spark, sf).select("doc_id", "line", en.grammar_head("core").alias("head"))


POINTERS = [(r"^[^\s]*( \(.*?\))?:", False), (r"^\S+, (o\(|v\.) ", True), (r"^(An|The|De)[a-z]* ", True)]


_POINTS = " OR ".join("regexp_matches({}, '{}')".format("replace(core, '$$', '')" if bare else "core", p) for p, bare in POINTERS)


@query("x12_cross_references", f"WITH {_ENT} SELECT doc_id, line FROM ent WHERE NOT ({_POINTS})")
def cross_references(spark, sf):
    return en.without_cross_references(_entries(spark, sf), POINTERS).select("doc_id", "line")


# entries of every shape that points elsewhere, made of the first words of a line; two shapes that stay
SHAPES = ["{0}: {1} {2}", "{0}, {1}, for {2}.", "{0}, = {1} ({2})", "{0}, v. {1}.", "{0}, f.l. for {1}.", "{0}, poet. for {1}, {2}", "{0}, {1}, Ep. for {2}.", "{0}, part. of {1}, {2}", "{0}, Ep. dat. of {1}.",
          "{0}, v. {1}. {2}, v. {3}.", "{0}, Ep. 3sg. aor. of {1}.", "{0}, Dor. acc. pl. of {1} (q. v.).", "{0}, {1}, poet. forms, v. {2}.", "{0}, acc. sg., dual {1}, pl. {2}; v. {3}.",
          "{0}, o(, {1} {2}", "{0}, $$v. {1}.", "{0} {1}, like {2}, {3}"]
_SHAPE_SQL = "CASE (doc_id + line) % " + str(len(SHAPES)) + " " + " ".join(
    "WHEN {} THEN {}".format(k, " || ".join("w[" + str(int(p) + 1) + "]" if p.isdigit() else "'" + p + "'" for p in re.split(r"[{}]", s) if p)) for k, s in enumerate(SHAPES)) + " END"
_POINTING = c.SQL_LINES + f""",
wd AS (SELECT doc_id, line, list_transform(string_split(text, ' ')[1:4], lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')) AS w FROM lines),
ent AS (SELECT doc_id, line, {_SHAPE_SQL} AS core FROM wd WHERE len(w) = 4)"""


def pointing_entries(spark, sf):
    li = c.doc_lines(spark, sf).withColumn("line", F.col("line").cast("long"))
    w = F.transform(F.slice(F.split("text", " "), 1, 4), lambda x: F.regexp_replace(F.lower(x), "[^a-z]", ""))
    li = li.select("doc_id", "line", w.alias("w")).filter(F.size("w") == 4)
    kind = (F.col("doc_id") + F.col("line")) % len(SHAPES)
    shaped = [F.concat(*[F.get("w", F.lit(int(p))) if p.isdigit() else F.lit(p) for p in re.split(r"[{}]", s) if p]) for s in SHAPES]
    return li.select("doc_id", "line", F.element_at(F.array(*shaped), (kind + 1).cast("int")).alias("core"))


def _points(k, p, bare):
    text = "replace(core, '$$', '')" if bare else "core"
    return f"regexp_matches({text}, '{p}')"


@query("x12_all_cross_references", f"WITH {_POINTING} SELECT doc_id, line, core FROM ent WHERE NOT ({' OR '.join(_points(k, *x) for k, x in enumerate(rf.CROSS_REFERENCES))})")
def all_cross_references(spark, sf):
    return en.without_cross_references(pointing_entries(spark, sf)).select("doc_id", "line", "core")


@query("x12_pattern_hits", f"WITH {_POINTING} " + " UNION ALL ".join(f"SELECT {k} AS pattern, count(*) FILTER (WHERE {_points(k, *x)}) AS n FROM ent" for k, x in enumerate(rf.CROSS_REFERENCES)))
def pattern_hits(spark, sf):
    return en.cross_reference_hits(pointing_entries(spark, sf))


ROUND1 = [(r"os[ ,.]", "second", "core"), (r"(ei|ou)n", "verb", "core"), (r"^[^\s]*a[,\s]", "first", "core"), (r"tion[a-z]*", "abstract", "core"), (r"th(e|at)", "article", "core"), (r"[^\s]*en[,.]", "plural", "core")]
ROUND2 = [(r"^[A-Z][a-z]*\.", "name", "core"), (r"is", "third", "core")]


def _round_sql(rules, name):
    cells = []
    for no, (p, cls, _) in enumerate(rules):
        anchored = p if p.startswith("^") else f"(?s)^.*?(?-s:{p})"
        cells.append(f"CASE WHEN regexp_matches(core, '{p}') THEN {{'e': length(regexp_extract(core, '{anchored}', 0)), 'no': {no}, 'cls': '{cls}'}} END")
    return f"(list_sort(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL))[1]).cls AS {name}"


@query("x13_x14_classify", f"""WITH {_ENT},
k AS (SELECT doc_id, line, string_split(core, ' ')[1] AS w, {_round_sql(ROUND1, 'a')}, {_round_sql(ROUND2, 'b')} FROM ent),
ex AS (SELECT DISTINCT string_split(text, ' ')[1] AS w FROM benchmark)
SELECT doc_id, line, coalesce(CASE WHEN k.w IN (SELECT w FROM ex) THEN 'exact' END, a, b, 'other') AS class,
  CASE WHEN coalesce(CASE WHEN k.w IN (SELECT w FROM ex) THEN 'exact' END, a, b, 'other') IN ('exact', 'verb', 'article') THEN coalesce(CASE WHEN k.w IN (SELECT w FROM ex) THEN 'exact' END, a, b, 'other') ELSE 'rest' END AS class_group FROM k""")
def classify(spark, sf):
    e = _entries(spark, sf).withColumn("headword", F.split("core", " ")[0])
    exact = c.load(spark, sf, "benchmark").select(F.split("text", " ")[0].alias("word")).distinct().withColumn("class", F.lit("exact"))
    k = en.classify(e, exact, [ROUND1, ROUND2])
    return en.group_small(k, ["exact", "verb", "article"]).select("doc_id", "line", "class", "class_group")


# 190 rules made from letters: three shapes over pairs of them
_RULE_ENDS = [a + b for a in "abcdefghilmnoprst" for b in "aeinorstu"]
MANY = [((rf"{e}[ ,.]", rf"^[A-Z]?[a-z]*{e}[a-z]* (the|der|la) ", rf"[a-z]{e}{e[0]}?(is|en)")[k % 3], f"class {k % 23}", "core") for k, e in enumerate(_RULE_ENDS)] + \
    [(rf"{a}{b}{a}", f"twice {a}", "core") for a in "aeiou" for b in "bcdlmnr"] + [(r"[0-9]+", "number", "core"), (r"^\S+:", "colon", "core")]


def _many_sql(rules):
    cells = []
    for no, (p, cls, _) in enumerate(rules):
        anchored = p if p.startswith("^") else f"(?s)^.*?(?-s:{p})"
        cells.append(f"CASE WHEN regexp_matches(core, '{p}') THEN {{'e': length(regexp_extract(core, '{anchored}', 0)), 'no': {no}, 'cls': '{cls}'}} END")
    return f"(list_sort(list_filter([{', '.join(cells)}], lambda x: x IS NOT NULL))[1]).cls"


@query("x13_many_rules", f"WITH {_ENT} SELECT doc_id, line, coalesce({_many_sql(MANY[:120])}, {_many_sql(MANY[120:])}, 'other') AS class FROM ent")
def classify_many(spark, sf):
    return en.classify_many(_entries(spark, sf).withColumn("headword", F.lit("x")), None, [MANY[:120], MANY[120:]]).select("doc_id", "line", "class")


@query("x15_x16_links_and_variants", f"""WITH {_ENT},
r AS (SELECT doc_id, line, string_split(core, ' ') AS ws FROM ent),
e AS (SELECT doc_id, line, ws[1] AS w, ', (' || translate(coalesce(ws[2], ''), '$,.:', '') || ', cf. x) ' AS rest, CASE WHEN line % 2 = 0 THEN ws[1] || ' or ' || coalesce(ws[2], '') || CASE WHEN line % 4 = 0 THEN ', x' ELSE ' x' END ELSE ws[1] || ' x' END AS c2 FROM r),
v AS (SELECT *, regexp_extract(c2, '^\\S+ or ([^\\s,]+),', 1) AS two FROM e)
SELECT doc_id, line, regexp_extract(rest, '^,?\\s*(?:\\$\\$)?(?:(?:Ion)\\. Noun,)?\\s*\\(([A-Za-z)(/=\\\\+|&'']*?)(?:, cf\\. .*?)?\\)\\s+', 1) AS link,
  unnest(CASE WHEN two <> '' THEN [w, two] ELSE [w] END) AS start FROM v""")
def links(spark, sf):
    ws = F.split("core", " ")
    second = F.coalesce(F.get(ws, F.lit(1)), F.lit(""))
    e = _entries(spark, sf).select(
        "doc_id", "line", ws[0].alias("headword"), F.concat(F.lit(", ("), F.translate(second, "$,.:", ""), F.lit(", cf. x) ")).alias("rest"),
        F.when(F.col("line") % 2 == 0, F.concat(ws[0], F.lit(" or "), second, F.when(F.col("line") % 4 == 0, ", x").otherwise(" x"))).otherwise(F.concat(ws[0], F.lit(" x"))).alias("core"))
    return en.start_variants(e).select("doc_id", "line", en.related_word("rest").alias("link"), "start")


# ---- vowel lengths --------------------------------------------------------------------------------------

_DEF = r"translate(regexp_replace(translate(regexp_replace(regexp_replace({0}, '([aeiouhwj])\+', '.\1', 'g'), '[aeou]i|[aoehw]u|[hw]', 'L', 'g'), 'eoaiu', 'SSQQQ'), '[^LSQ]', '', 'g'), 'LSQ', 'ls?')"


@query("x17_x20_x21_lengths", f"""WITH {c.SQL_TOKENS}, w AS (SELECT DISTINCT token FROM std)
SELECT token, {_DEF.format('token')} AS lengths, NOT regexp_matches(regexp_replace(token, '[aeou]i|[aoehw]u', '1', 'g'), '[aiu]') AS known,
  translate(regexp_replace(translate(regexp_replace(regexp_replace(regexp_replace(token, '[aeou]i|[aoehw]u', 'L', 'g'), '[aiu][_=]|[hw]', 'L', 'g'), '[aiu]\\^|[eo]', 'S', 'g'), 'aiu', 'QQQ'), '[^LSQ]', '', 'g'), 'LSQ', 'ls?') AS stem FROM w WHERE NOT contains(token, '+')""")
def lengths(spark, sf):
    return vocabulary(spark, sf).filter(~F.contains("token", F.lit("+"))).select(
        "token", ph.default_lengths("token").alias("lengths"), ph.only_known_vowels("token").alias("known"), en.stem_lengths("token").alias("stem"))


# A dictionary derived from the morphology: every parse's lemma has an entry of its own, whose stems are the token less its last letters.
ENDING_TYPES = ["firstDeclensionEta", "secondDeclensionOS", "firstDeclensionShortAlpha", "secondDeclensionHS", "thirdDeclensionSigmaStemNeuter", "thirdDeclensionConsonantStem",
                "thirdDeclensionIotaStem", "thirdDeclensionDigammaStem", "thirdDeclensionU/", "thematicVerb", "oContractVerb", "eContractVerb", "aContractVerb", "pronounMin", "adjectiveTis",
                "verbEndingInUmi", "nounZeu/s", "nounXeir", "pronounEgw", "adjectivePolus", "verbOida", "indecl"]
ENTRY_POS = ["??", "adv", "noun", "adj", "verb"]
SLOTS = ["*", "rest", "masc", "fem", "neut", "neutNom", "mascNom", "pres.act", "aor.act.y", "fut.mid", "futperf"]


def dictionary(spark, sf):
    """Entries and stems of the lemmas of _dict_forms; one entry in eight is missing, some stems carry a digamma, a third have stems by slot."""
    p = _dict_forms(spark, sf).select("token", "parse_no", "lemma").filter((part(80) % 8 != 0) & F.contains("lemma", F.lit(":")))
    entries = p.select("lemma", chosen(ENTRY_POS, 81).alias("entry_pos"), chosen(ENDING_TYPES, 82).alias("ending_type"))
    slots = F.explode(F.when(part(83) % 3 == 0, F.array(*[F.lit(x) for x in SLOTS[1:]])).otherwise(F.array(F.lit("*"))))
    stems = p.select("*", slots.alias("slot")).select("*", F.explode(F.array(*[F.lit(k) for k in (0, 1, 2, 3)])).alias("variant_no"))
    cut = F.substr("token", F.lit(1), F.length("token") - (part(84) + F.col("variant_no")) % 4)
    stem = F.when((part(85) + F.col("variant_no")) % 5 == 0, F.concat(F.lit("v"), cut)).otherwise(F.translate(cut, "/=", ""))
    return entries, stems.select("lemma", "slot", "variant_no", stem.alias("stem"), F.translate(ph.default_lengths(stem), "?", "s").alias("stem_lengths"))


def _dict_forms(spark, sf):
    return parses(spark, sf).withColumn("lemma", F.when(part(86) % 16 == 0, F.col("lemma")).otherwise(F.concat("lemma", F.lit(":"), "token", F.lit(":"), F.col("parse_no").cast("string"))))


@query("x18_stem_slot", f"""WITH {SQL_PARSES},
v AS (SELECT *, coalesce(tense, CASE WHEN lemma IN ('fhmi/', 'e)/dw') OR form = 'e)pi/staito' THEN 'pres' END) AS te, coalesce(voice, 'act') AS vo FROM parses),
f AS (SELECT *, CASE WHEN te = 'aor' AND vo = 'mp' THEN 'mid' WHEN te IN ('imperf', 'plup') AND vo IN ('mid', 'pass') THEN 'mp' WHEN te = 'fut' AND vo = 'mp' THEN 'mid' WHEN te IN ('pres', 'perf') AND vo IN ('mid', 'pass') THEN 'mp' ELSE vo END AS fo,
  CASE WHEN coalesce(feature = 'unaugmented', false) OR pos = 'part' THEN 'n' ELSE 'y' END AS au FROM v),
s AS (SELECT CASE WHEN pos = 'verb' THEN CASE WHEN te = 'futperf' THEN te WHEN te IN ('imperf', 'aor', 'plup') THEN te || '.' || fo || '.' || au WHEN te IS NOT NULL THEN te || '.' || fo END
  WHEN pos = 'noun' THEN 'rest' WHEN pos = 'adj' THEN CASE WHEN gender IS NULL THEN 'neutNom' WHEN "case" = 'nom' AND gender IN ('masc', 'neut') THEN gender || 'Nom' ELSE gender END ELSE '*' END AS slot FROM f)
SELECT slot, count(*) AS n FROM s GROUP BY slot""")
def slots(spark, sf):
    return parses(spark, sf).withColumn("entry_pos", F.lit("??")).withColumn("slot", lx.stem_slot()).groupBy("slot").agg(F.count("*").alias("n"))


# The lists of endings written out: class, place, lengths, endings (* a prefix), number of the condition below
_LISTS = """rw(cls, no, lens, ends, cond) AS (VALUES
('long_a', 1, 's', 'as', 1), ('long_a', 2, 's', 'a', 2), ('long_a', 3, 'l', 'a', 3), ('long_a', 4, 'l', 'as an a|', 0), ('long_a', 5, 'ls', 'h|si* a|si* oisi*', 0),
('short_a', 1, 's', 'a an', 0), ('short_a', 2, 'l', 'as a|', 0), ('short_a', 3, 'ls', 'h|si* a|si* oisi*', 0),
('masc_hs', 1, 's', 'a', 4), ('adj_hs', 1, 'ss', 'esi* essi*', 0), ('adj_hs', 2, 's', 'si*', 0),
('third', 1, '?s', 'a)nhr a)ndri a)ndra a)ndras a)ndros a)ndres', 5), ('third', 2, '?ss', 'a)ndrasi* a)ndresi*', 5), ('third', 3, '?l', 'a)ndrwn', 5),
('third', 4, 'ls', 'mater matri mhtri', 6), ('third', 5, 'lss', 'materi mhteri materos matera', 6), ('third', 6, 's', 'i a as si*', 0), ('third', 7, 'ss', 'essi*', 0),
('iota', 1, 's', 'is i in', 0), ('iota', 2, 'ss', 'esi* essi*', 0), ('digamma', 1, 'l', 'a', 0), ('digamma', 2, 'sl', 'ea eas', 0), ('digamma', 3, 'ls', 'eusi*', 0),
('adj_us', 11, 's', 'us un u', 0), ('adj_us', 12, 'ss', 'ea esi*', 0),
('verb', 1, 's', 'a as an', 7), ('verb', 2, 'ss', 'amen ate ato anto', 7), ('verb', 3, 'ls', 'hsan', 7), ('verb', 4, 'l', 'a as', 8), ('verb', 5, 'ls', 'amen ate', 8),
('verb', 6, 'll', 'asi*', 8), ('verb', 7, 'ss', 'esan', 9), ('verb', 8, 'ss', 'ion', 10), ('verb', 9, 'ls', 'wsi* h|si* wmi h|sqa oimi aimi eian meqa onta', 10),
('verb', 10, 'sss', 'omeqa', 10), ('verb', 11, 'lss', 'wmeqa w|meqa oimeqa', 10), ('verb', 12, 'lls', 'eihsan eihsi eih|si', 10),
('e_contract', 1, 'sls', 'eoisi*', 11), ('a_contract', 1, 'l', 'a as a| a|s an aq'' at''', 11), ('a_contract', 2, 'll', 'atai', 11), ('a_contract', 3, 'ls', 'ate ato asqe asa', 11),
('min', 1, 's', 'min nin', 0), ('tis', 1, 's', 'is i', 0), ('tis', 2, 'ss', 'inos ini ina ines inas isi*', 0), ('tis', 3, 'sl', 'inwn', 0),
('umi', 1, 'l', 'us un u', 0), ('umi', 2, '?', 'us''', 0), ('umi', 3, 's', 'unt'' ut'' uq'' usq''', 0), ('umi', 4, 'ls', 'umi usi*', 0),
('umi', 5, 'ss', 'umen ute usqe usan uso uto umeq''', 0), ('umi', 6, 'sl', 'umai usai utai untai umhn utw untwn usqw usqwn unai usqai', 0), ('umi', 7, 'sls', 'uasi*', 0), ('umi', 8, 'sss', 'umeqa', 0),
('zeus', 1, 'ss', 'zeus dios dii dia', 0), ('zeus', 2, 'l', 'zeu di zhn', 0), ('zeus', 3, 'ls', 'zhnos zhni zhna', 0),
('xeir', 1, 'l', 'xeir', 0), ('xeir', 2, 'ls', 'xeiros xeiri xeirsi* xeira xeire xeires xeiras', 0), ('xeir', 3, 'll', 'xeirwn xeiroin', 0), ('xeir', 4, 'ss', 'xersi*', 0),
('ego', 1, 'l?', 'h(min h(mas', 0), ('polus', 1, 's', 'u un', 0), ('polus', 2, 'ss', 'ea', 0),
('oida', 1, 'ls', 'oida oidqa h|san', 0), ('oida', 2, 'lss', 'hdesan', 0), ('oida', 3, 'lls', 'hdhsqa', 0), ('oida', 4, 'ss', 'idmen ismen iste isqi', 0), ('oida', 5, 'sl', 'istw istwn', 0),
('oida', 6, 'sls', 'isasi*', 0), ('oida', 7, 'llls', 'eideihsan', 0)),
ty(ending_type, cls) AS (VALUES ('firstDeclensionEta', 'long_a'), ('secondDeclensionOS', 'long_a'), ('firstDeclensionShortAlpha', 'short_a'), ('secondDeclensionHS', 'masc_hs'),
('thirdDeclensionSigmaStemNeuter', 'adj_hs'), ('thirdDeclensionConsonantStem', 'third'), ('thirdDeclensionIotaStem', 'iota'), ('thirdDeclensionDigammaStem', 'digamma'), ('thirdDeclensionU/', 'adj_us'),
('thematicVerb', 'verb'), ('oContractVerb', 'verb'), ('eContractVerb', 'e_contract'), ('aContractVerb', 'a_contract'), ('pronounMin', 'min'), ('adjectiveTis', 'tis'), ('verbEndingInUmi', 'umi'),
('nounZeu/s', 'zeus'), ('nounXeir', 'xeir'), ('pronounEgw', 'ego'), ('adjectivePolus', 'polus'), ('verbOida', 'oida')),
-- classes that go on with the rows of another one, behind their own (adj_us: before them)
inc(cls, src, base, outer_cond) AS (SELECT DISTINCT cls, cls, 0, 0 FROM rw UNION ALL VALUES ('masc_hs', 'long_a', 100, 0), ('adj_us', 'short_a', 0, 0), ('e_contract', 'verb', 100, 12), ('a_contract', 'verb', 100, 12), ('polus', 'long_a', 100, 0)),
le AS (SELECT inc.cls, base + no AS no, lens, rtrim(e, '*') AS listed, e LIKE '%*' AS pre, cond, outer_cond FROM inc JOIN (SELECT * EXCLUDE (ends), unnest(string_split(ends, ' ')) AS e FROM rw) r ON r.cls = inc.src)"""
_COND = """CASE {0} WHEN 0 THEN true WHEN 1 THEN lemma = 'ui(o/s' WHEN 2 THEN gender = 'neut' WHEN 3 THEN gender = 'fem' WHEN 4 THEN "case" = 'voc' WHEN 5 THEN lemma = 'a)nh/r' WHEN 6 THEN lemma = 'mh/thr'
 WHEN 7 THEN pos <> 'part' AND tense = 'aor' WHEN 8 THEN pos <> 'part' AND tense = 'perf' WHEN 9 THEN pos <> 'part' AND tense = 'plup' WHEN 10 THEN pos <> 'part'
 WHEN 11 THEN tense IN ('pres', 'imperf') ELSE tense IS NULL OR tense NOT IN ('pres', 'imperf') END"""
_SLOT = """CASE WHEN ep = 'verb' THEN CASE WHEN te = 'futperf' THEN te WHEN te IN ('imperf', 'aor', 'plup') THEN te || '.' || fo || '.' || au WHEN te IS NOT NULL THEN te || '.' || fo END
  WHEN ep = 'noun' THEN 'rest' WHEN ep = 'adj' THEN CASE WHEN pos = 'adv' OR gender IS NULL THEN 'neutNom' WHEN "case" = 'nom' AND gender IN ('masc', 'neut') THEN gender || 'Nom' ELSE gender END ELSE '*' END"""
_LENGTHS = SQL_PARSES + f""",
df AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {sql_part(86)} % 16 = 0 THEN lemma ELSE lemma || ':' || token || ':' || parse_no END AS lemma) FROM parses),
has AS (SELECT token, parse_no, lemma FROM df WHERE {sql_part(80)} % 8 <> 0),
en AS (SELECT lemma, {sql_chosen(ENTRY_POS, 81)} AS entry_pos, {sql_chosen(ENDING_TYPES, 82)} AS ending_type FROM has WHERE contains(lemma, ':')),
sl AS (SELECT *, unnest(CASE WHEN {sql_part(83)} % 3 = 0 THEN {_list(SLOTS[1:])} ELSE ['*'] END) AS slot FROM has WHERE contains(lemma, ':')),
sv AS (SELECT *, left(token, CAST(greatest(length(token) - ({sql_part(84)} + variant_no) % 4, 0) AS INTEGER)) AS cut FROM (SELECT *, unnest([0, 1, 2, 3]) AS variant_no FROM sl)),
sm AS (SELECT lemma, slot, variant_no, CASE WHEN ({sql_part(85)} + variant_no) % 5 = 0 THEN 'v' || cut ELSE translate(cut, '/=', '') END AS stem FROM sv),
st1 AS (SELECT *, replace({_DEF.format('stem')}, '?', 's') AS stem_lengths FROM sm),
w1 AS (SELECT df.*, entry_pos, ending_type, CASE WHEN entry_pos = '??' THEN pos ELSE entry_pos END AS ep, coalesce(tense, CASE WHEN df.lemma IN ('fhmi/', 'e)/dw') OR form = 'e)pi/staito' THEN 'pres' END) AS te, coalesce(voice, 'act') AS vo,
  CASE WHEN coalesce(feature = 'unaugmented', false) OR pos = 'part' THEN 'n' ELSE 'y' END AS au FROM df JOIN en USING (lemma)),
w2 AS (SELECT *, CASE WHEN te = 'aor' AND vo = 'mp' THEN 'mid' WHEN te IN ('imperf', 'plup') AND vo IN ('mid', 'pass') THEN 'mp' WHEN te = 'fut' AND vo = 'mp' THEN 'mid' WHEN te IN ('pres', 'perf') AND vo IN ('mid', 'pass') THEN 'mp' ELSE vo END AS fo FROM w1),
w3 AS (SELECT *, {_SLOT} AS want FROM w2),
cd AS (SELECT w3.*, stem, stem_lengths, variant_no, translate(token, '=/', '') AS plain, replace(stem, 'v', '') AS chk FROM w3 JOIN st1 ON w3.lemma = st1.lemma AND (st1.slot = '*' OR st1.slot = w3.want)),
c2 AS (SELECT * EXCLUDE (ending), CASE WHEN NOT starts_with(ending, '+') THEN ending END AS ending FROM (SELECT *, CASE WHEN starts_with(plain, chk) THEN CASE WHEN starts_with(token, stem) THEN translate(regexp_replace(
   CASE WHEN contains(token, chk) THEN left(token, strpos(token, chk) - 1) || substr(token, strpos(token, chk) + length(chk)) ELSE token END, '([aoehw])[/=+]([iu])', '\\1\\2+', 'g'), '=/', '')
   ELSE substr(plain, length(chk) + 1) END END AS ending FROM cd)),
c3 AS MATERIALIZED (SELECT *, NOT regexp_matches(regexp_replace(replace(replace(ending, 'i+', 'I'), 'u+', 'U'), '[aeou]i|[aoehw]u', '1', 'g'), '[aiuIU]') AS easy FROM c2 WHERE ending IS NOT NULL),
{_LISTS},
hits AS (SELECT c3.token, c3.parse_no, c3.variant_no, arg_min(le.lens, le.no) AS lens FROM c3 JOIN ty USING (ending_type) JOIN le USING (cls)
  WHERE NOT easy AND CASE WHEN pre THEN starts_with(CASE WHEN cls = 'oida' THEN replace(ending, ')', '') ELSE ending END, listed) ELSE CASE WHEN cls = 'oida' THEN replace(ending, ')', '') ELSE ending END = listed END
    AND coalesce({_COND.format('cond')}, false) AND coalesce({_COND.format('outer_cond')}, false) GROUP BY ALL),
c4 AS (SELECT c3.*, hits.lens AS listed, coalesce(hits.lens, {_DEF.format('ending')}) AS ending_lengths, ending_type = 'verbOida' AS oida FROM c3 LEFT JOIN hits USING (token, parse_no, variant_no)),
c5 AS (SELECT *, CASE WHEN oida AND (listed IS NOT NULL OR easy) THEN 'v' ELSE '' END || CASE WHEN oida AND listed IS NOT NULL THEN replace(ending, ')', '') ELSE ending END AS new_ending, stem_lengths || ending_lengths AS whole FROM c4),
ok1 AS (SELECT token, parse_no, arg_min(whole, variant_no) AS lengths, arg_min(stem || CASE WHEN new_ending = '' OR left(new_ending, 1) IN ('''', '(', ')', '+') THEN '' ELSE '.' END || new_ending, variant_no) AS spelling
  FROM c5 WHERE length(whole) = length({_DEF.format('token')}) GROUP BY ALL),
pl AS MATERIALIZED (SELECT df.token, df.parse_no, coalesce(lengths, {_DEF.format('df.token')}) AS lengths, coalesce(spelling, df.token) AS spelling FROM df LEFT JOIN ok1 USING (token, parse_no))"""


@query("x18_stems_of_parses", f"WITH {_LENGTHS} SELECT token, parse_no, ending_type, variant_no, stem, ending FROM c2")
def stems_of_parses(spark, sf):
    found = lx.split_ending(lx.stems_of_parses(_dict_forms(spark, sf), *dictionary(spark, sf)))
    return found.filter("stem IS NOT NULL").select("token", "parse_no", "ending_type", "variant_no", "stem", "ending")


@query("x19_x22_parse_lengths", f"WITH {_LENGTHS} SELECT * FROM pl")
def parse_lengths(spark, sf):
    return lx.parse_lengths(_dict_forms(spark, sf), *dictionary(spark, sf))


@query("x19_listed_endings", f"WITH {_LENGTHS} SELECT ending_type, ending, ending_lengths, new_ending, count(*) AS n FROM c5 GROUP BY ALL")
def listed_endings(spark, sf):
    found = lx.ending_lengths(lx.split_ending(lx.stems_of_parses(_dict_forms(spark, sf), *dictionary(spark, sf))))
    return found.filter("ending IS NOT NULL").groupBy("ending_type", "ending", "ending_lengths", "new_ending").agg(F.count("*").alias("n"))


_UNI = f"""WITH {SQL_PARSES},
pl AS (SELECT token, parse_no, CASE WHEN parse_no = 1 AND length(token) % 3 = 0 THEN translate(dl, '?', 's') WHEN parse_no = 2 AND length(token) % 4 = 0 THEN dl || 'l' WHEN parse_no = 2 THEN translate(dl, '?', 'l') ELSE dl END AS lens
  FROM (SELECT token, parse_no, {_DEF.format('token')} AS dl FROM parses)),
sz AS (SELECT token, min(length(lens)) AS lo, max(length(lens)) AS hi, count(*) AS n_parses FROM pl GROUP BY token),
px AS (SELECT token, i, count(DISTINCT substr(lens, i, 1)) AS k, min(substr(lens, i, 1)) AS c FROM (SELECT token, lens, CAST(unnest(range(1, length(lens) + 1)) AS INTEGER) AS i FROM pl) GROUP BY ALL),
st AS (SELECT token, string_agg(CASE WHEN k = 1 THEN c ELSE '?' END, '' ORDER BY i) AS lens FROM px GROUP BY token)
SELECT sz.token, lo = hi AS unified, CASE WHEN lo = hi THEN coalesce(lens, '') END AS lengths, sz.token AS spelling, n_parses FROM sz LEFT JOIN st USING (token)"""


@query("x23_unify_lengths", _UNI)
def unify(spark, sf):
    d = ph.default_lengths("token")
    size = F.length("token")
    p = parses(spark, sf).select("token", "parse_no", F.col("token").alias("spelling"),
                                 F.when((F.col("parse_no") == 1) & (size % 3 == 0), F.translate(d, "?", "s"))
                                 .when((F.col("parse_no") == 2) & (size % 4 == 0), F.concat(d, F.lit("l")))
                                 .when(F.col("parse_no") == 2, F.translate(d, "?", "l")).otherwise(d).alias("lengths"))
    return lx.unify_lengths(p)


# ---- both readings of a line --------------------------------------------------------------------------------

_TAGGED = r"""regexp_replace(regexp_replace(array_to_string(list_transform({0}, lambda x, i: CASE WHEN regexp_matches(x, '^[aeiouhw]') THEN '.' || regexp_extract(x, '^(?:[aeou]i|[aoehw]u|[a-z])')
  || replace(translate(substr({1}, len(list_filter({0}[1:i], lambda y: regexp_matches(y, '^[aeiouhw]'))), 1), 'ls', '_^'), '?', '') || substr(x, length(regexp_extract(x, '^(?:[aeou]i|[aoehw]u|[a-z])')) + 1) ELSE '.' || x END), ''), '\.+', '.', 'g'), '^\.', '')"""
_PARTS_SQL = r"regexp_extract_all(regexp_replace({0}, '([aeiouhwj])\+', '.\1', 'g'), '(?:[aeou]i|[aoehw]u|[a-z])[^a-z]*|^[^a-z]+')"
_READINGS = _LENGTHS + f""",
sz AS (SELECT token, min(length(lengths)) AS lo, max(length(lengths)) AS hi, arg_min(spelling, 1000 * length(translate(spelling, '/=', '')) + parse_no) AS spelling FROM pl GROUP BY token),
px AS (SELECT token, i, count(DISTINCT substr(lengths, i, 1)) AS k, min(substr(lengths, i, 1)) AS c FROM (SELECT token, lengths, CAST(unnest(range(1, length(lengths) + 1)) AS INTEGER) AS i FROM pl) GROUP BY ALL),
un AS (SELECT token, string_agg(CASE WHEN k = 1 THEN c ELSE '?' END, '' ORDER BY i) AS lens FROM px GROUP BY token),
nt AS (SELECT sz.token, CASE WHEN lo = hi THEN spelling ELSE sz.token END AS word, CASE WHEN lo = hi THEN coalesce(lens, '') ELSE {_DEF.format('sz.token')} END AS lens FROM sz LEFT JOIN un USING (token)),
np AS (SELECT *, {_PARTS_SQL.format('word')} AS ps FROM nt),
tg AS (SELECT token, {_TAGGED.format('ps', 'lens')} AS native FROM np),
fc AS (SELECT token, bool_and({_ISENC}) AS enc, bool_and({_ISPRO}) AS pro FROM df GROUP BY token),
vs AS (SELECT doc_id, text_name, book, unnest(l) AS text, generate_subscripts(l, 1) AS line FROM (SELECT doc_id, text_name, book, regexp_extract_all(text, '\\S+(?:\\s+\\S+){{0,5}}') AS l FROM docs)),
vc AS (SELECT doc_id, text_name, book, line, {c.sql_clean_line(c.sql_decap_line('text'))} AS clean FROM vs),
vw AS (SELECT * FROM (SELECT doc_id, text_name, book, line, unnest(string_split(clean, ' ')) AS raw, generate_subscripts(string_split(clean, ' '), 1) AS p FROM vc) WHERE raw <> ''),
v2 AS (WITH {c.sql_standardize_ctes('vw', 'raw', 'doc_id, line, p, raw')} SELECT * FROM std),
v3 AS (SELECT v2.*, tg.native, fc.token IS NOT NULL AS known, coalesce(enc, false) AS enc, coalesce(pro, false) AS pro, {_DEF.format('raw')} AS rl, {_PARTS_SQL.format('raw')} AS rp FROM v2 LEFT JOIN fc ON fc.token = v2.token LEFT JOIN tg ON tg.token = v2.token),
v4 AS (SELECT *, CASE WHEN known THEN token ELSE raw END AS s0, CASE WHEN known THEN native ELSE {_TAGGED.format('rp', 'rl')} END AS s1, lead(enc) OVER (PARTITION BY doc_id, line ORDER BY p) AS next_enc FROM v3),
v5 AS (SELECT *, CASE WHEN NOT enc AND pro THEN '.' WHEN coalesce(next_enc, false) THEN '.' ELSE ' ' END AS gap FROM v4),
rd AS MATERIALIZED (SELECT doc_id, line, string_agg(s0 || gap, '' ORDER BY p) AS student, string_agg(s1 || gap, '' ORDER BY p) AS native FROM v5 GROUP BY ALL)"""


def readings(spark, sf):
    v = sc.clean_verses(c.verses(spark, sf)).withColumn("line", F.col("line").cast("long"))
    words = lx.reading_tokens(_dict_forms(spark, sf), *dictionary(spark, sf))
    return sc.line_readings(v, words, ["doc_id", "line"], {"native": ("native", ph.NATIVE), "student": ("student", ph.STUDENT)})


@query("s02_s03_both_readings", f"WITH {_READINGS} SELECT vc.doc_id, text_name, book, vc.line, clean AS text, native, student FROM vc LEFT JOIN rd ON rd.doc_id = vc.doc_id AND rd.line = vc.line")
def both_readings(spark, sf):
    return readings(spark, sf)


# every line is scanned twice: its number doubled for the native reading, and one more for the other
_TWICE = f"WITH {_READINGS}" + r""",
ln AS MATERIALIZED (SELECT vc.doc_id, text_name, book, 2 * vc.line + unnest([0, 1]) AS line, unnest([native, student]) AS text FROM vc LEFT JOIN rd ON rd.doc_id = vc.doc_id AND rd.line = vc.line),
snd AS (SELECT doc_id, text_name, book, line, regexp_extract_all(regexp_replace(text, '([aeiouhwj])\+', '.\1', 'g'), '(?:[aeou]i|[aoehw]u|[a-z])[^a-z. ]*| ') AS s FROM ln)"""
_HEAVY = "CASE WHEN line % 2 = 0 THEN core IN ('h', 'w') OR circ OR contains(v, '_') ELSE core IN ('h', 'w') OR circ OR len(core) > 1 END AS heavy"
_LIGHT = "(CASE WHEN line % 2 = 0 THEN NOT circ AND NOT contains(v, '_') AND (core IN ('e', 'o') OR contains(v, '^')) ELSE core IN ('e', 'o') AND NOT circ END)"
_BOTH_SCANS = (q_scan.CANDIDATES.replace(q_scan.SOUNDS, _TWICE).replace("core IN ('h', 'w') OR circ OR len(core) > 1 AS heavy", _HEAVY)
               .replace("core IN ('e', 'o') AND NOT circ", _LIGHT).replace("FROM lines LEFT JOIN hit", "FROM ln LEFT JOIN hit").replace("SELECT lines.doc_id, text_name, book, lines.line,", "SELECT ln.doc_id, text_name, book, ln.line,") + """,
pair AS (SELECT n.doc_id, n.text_name, n.line // 2 AS line, n.scan_pass AS n_pass, n.feet AS n_feet, n.scanned AS n_ok, n.ambiguous AS n_amb, s.scan_pass AS s_pass, s.feet AS s_feet, s.scanned AS s_ok, s.ambiguous AS s_amb
  FROM scans n JOIN scans s ON n.doc_id = s.doc_id AND n.line + 1 = s.line WHERE n.line % 2 = 0)""")


@query("s02_s11_native_and_fallback", _BOTH_SCANS + """ SELECT doc_id, line, CASE WHEN n_ok THEN 'native' ELSE 'student' END AS approach, CASE WHEN n_ok THEN n_pass ELSE s_pass END AS scan_pass,
  CASE WHEN n_ok THEN n_feet ELSE s_feet END AS feet, CASE WHEN n_ok THEN n_ok ELSE s_ok END AS scanned, CASE WHEN n_ok THEN n_amb ELSE s_amb END AS ambiguous FROM pair""")
def fallback(spark, sf):
    out = sc.scan_fallback(readings(spark, sf), "native", "student")
    return out.select("doc_id", "line", "approach", "scan_pass", "feet", "scanned", "ambiguous")


@query("e04_approaches", _BOTH_SCANS + """, o AS (SELECT doc_id, line, s_feet AS ours, n_feet AS theirs, CASE WHEN s_feet IS NOT NULL AND n_feet IS NOT NULL THEN CASE WHEN s_feet = n_feet THEN 'agree' ELSE 'differ' END
  WHEN s_feet IS NOT NULL THEN 'theirs_failed' WHEN n_feet IS NOT NULL THEN 'ours_failed' ELSE 'both_failed' END AS outcome FROM pair) SELECT * FROM o WHERE outcome <> 'agree'""")
def approaches(spark, sf):
    student = sc.scan_lines(readings(spark, sf), "student", ph.STUDENT).select("doc_id", "line", "native", F.col("feet").alias("ours"))
    both = sc.scan_lines(student, "native", ph.NATIVE).select("doc_id", "line", "ours", F.col("feet").alias("theirs"))
    return ev.disagreements(both.withColumn("outcome", ev.outcome(F.col("ours"), F.col("theirs"))))
