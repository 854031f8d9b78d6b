"""D-*, R-*, F-*: dialect rules, roll-ups, feature matrix."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from queries import common as c, q_lexicon as ql, q_scan as qs
from stichos.functions import text as tx
from stichos.operators import dialect as di, line_features as lf, matrix as mx
from stichos.rules import table, votes

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# ---- D-*: parses that meet the rules: lemma and start of the form are drawn in pairs from the table ----

def _pairs():
    out = set()
    for _, arms in table.RULES.values():
        for test, _ in arms:
            names = [n for part in re.findall(r"lemma IN \(((?:'[^']*'(?:, )?)+)\)", test) for n in re.findall(r"'([^']*)'", part)]
            begins = re.findall(r"(?:left\(\w+, \d+\)|clean|substr\(clean, 2, 3\)) = '([^']*)'", test)
            begins += [n for part in re.findall(r"form IN \(((?:'[^']*'(?:, )?)+)\)", test) for n in re.findall(r"'([^']*)'", part)]
            out |= {(n, s) for n in names for s in (begins or ["x"])}
    return sorted(out)


PAIRS = _pairs()
SUFFIXES = sorted({s for _, arms in table.RULES.values() for test, _ in arms for s in re.findall(r"right\(\w+, \d+\) = '([^']*)'", test)})


def rule_parses(spark, sf, words=None):
    """Up to three parses per token, dense in words, classes and endings the rules know."""
    p = ql.parses(spark, sf, words)
    k = ql.part(70) % len(PAIRS) + 1
    lem, start = (F.element_at(F.array(*[F.lit(x[i]) for x in PAIRS]), k) for i in (0, 1))
    end = ql.chosen(SUFFIXES, 71)
    kind = ql.part(72) % 3
    return (p.withColumn("lemma", F.when(kind == 0, lem).when(kind == 1, ql.chosen(VERBS, 73)).otherwise(F.col("lemma")))
            .withColumn("form", F.when((kind == 0) & (ql.part(74) % 2 == 0), start).when(kind == 0, F.concat(start, "token", end))
                        .otherwise(F.concat("token", end)))
            .withColumn("pos", F.when(kind == 1, "verb").otherwise(F.col("pos"))))


VERBS = ["tima/w", "di/dwmi", "ti/qhmi", "te/xnaomai", "oi)=da", "ei)mi/", "lu/w"]


SQL_RULE_PARSES = ql.SQL_PARSES + f""",
rp1 AS (SELECT * EXCLUDE (lemma, form, pos), {ql.sql_part(72)} % 3 AS kind, lemma AS lm, pos AS ps,
  ({ql._list([x[0] for x in PAIRS])})[{ql.sql_part(70)} % {len(PAIRS)} + 1] AS pl, ({ql._list([x[1] for x in PAIRS])})[{ql.sql_part(70)} % {len(PAIRS)} + 1] AS st,
  {ql.sql_chosen(SUFFIXES, 71)} AS en, {ql.sql_chosen(VERBS, 73)} AS vb, {ql.sql_part(74)} % 2 AS exact FROM parses),
rp AS (SELECT * EXCLUDE (st, en, vb, exact, pl, lm, ps, kind), CASE kind WHEN 0 THEN pl WHEN 1 THEN vb ELSE lm END AS lemma,
  CASE WHEN kind = 0 AND exact = 0 THEN st WHEN kind = 0 THEN st || token || en ELSE token || en END AS form,
  CASE WHEN kind = 1 THEN 'verb' ELSE ps END AS pos, count(*) OVER (PARTITION BY token) AS n_parses FROM rp1),
prep AS (SELECT *, {c.sql_strip('form')} AS clean, {c.sql_strip('lemma')} AS clean_lemma FROM rp)"""


def _sq(values):
    return ql._list(values)


def _codes_sql(names):
    cells = ", ".join("{'rule': '" + r + "', 'code': " + table.case_expression(r, votes.code_of, '"') + "}" for r in names)
    return f"""voted AS (SELECT token, parse_no, n_parses, v.rule AS rule, v.code AS code, (v.code % 3) - 1 AS d0, (v.code // 3 % 3) - 1 AS d1, (v.code // 9) - 1 AS d2
 FROM (SELECT token, parse_no, n_parses, unnest([{cells}]) AS v FROM prep) WHERE v.code <> 13)"""


def prepared(spark, sf, words=None):
    return di.with_parse_count(di.prepare_parses(rule_parses(spark, sf, words)))


def _rule_query(prefix):
    names = [r for r in table.RULE_NAMES if r.startswith(prefix)]

    def run(spark, sf):
        v = di.rule_votes(prepared(spark, sf), names)
        return v.groupBy("rule", "code").agg(F.count("*").alias("n"), F.sum(F.length("token") * (F.col("parse_no") + 1)).cast("long").alias("mark"))

    return run, f"""WITH {SQL_RULE_PARSES}, {_codes_sql(names)}
SELECT rule, code, count(*) AS n, CAST(sum(length(token) * (parse_no + 1)) AS BIGINT) AS mark FROM voted GROUP BY ALL"""


for _prefix, _name in (("SW", "d_sw_rules"), ("NE", "d_ne_rules"), ("VE", "d_ve_rules"), ("NM", "d_nm_rules")):
    QUERIES[_name], ORACLES[_name] = _rule_query(_prefix)


# ---- R-* -------------------------------------------------------------------------------------------------

def _once(df):
    """A table that several branches of a query read, written and read back: pruned to the columns of each branch it would be computed once for each."""
    path = c.scratch(df.sparkSession, "once")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _voted(spark, sf):
    p = prepared(spark, sf)
    return p, di.rule_votes(p)


_VOTED = f"WITH {SQL_RULE_PARSES}, {_codes_sql(table.RULE_NAMES)}"
_OUTC = _VOTED + """,
ro AS (SELECT token, rule, count(*) AS k, any_value(n_parses) AS np, bit_or(1 << code) AS combo_max, sum(d0) AS s0, sum(d1) AS s1, sum(d2) AS s2 FROM voted GROUP BY ALL),
rules AS (SELECT token, rule, 1 AS possible_max, CAST(k = np AS INTEGER) AS possible_min, combo_max, CASE WHEN bit_count(combo_max) = 1 THEN combo_max ELSE 0 END AS combo_min,
  CAST(s0 > 0 AS INTEGER) + 2 * CAST(s1 > 0 AS INTEGER) + 4 * CAST(s2 > 0 AS INTEGER) AS dialect_max,
  CAST(s0 = np AS INTEGER) + 2 * CAST(s1 = np AS INTEGER) + 4 * CAST(s2 = np AS INTEGER) AS dialect_min FROM ro)"""


@query("r01_votes", _VOTED + " SELECT token, parse_no, count(*) AS n_votes, CAST(sum(code) AS BIGINT) AS codes FROM voted GROUP BY ALL")
def rule_votes(spark, sf):
    _, v = _voted(spark, sf)
    return v.groupBy("token", "parse_no").agg(F.count("*").alias("n_votes"), F.sum("code").alias("codes"))


@query("r02_rule_outcomes", _OUTC + " SELECT * FROM rules")
def rule_outcomes(spark, sf):
    return di.rule_outcomes(_voted(spark, sf)[1])


# verdicts in SQL: the parse's votes are walked in dialect order with list operations
_VERD = _OUTC + """,
hl AS (SELECT token, parse_no, [max(d0), max(d1), max(d2)] AS hi, [min(d0), min(d1), min(d2)] AS lo FROM voted GROUP BY ALL),
h2 AS (SELECT token, parse_no, list_transform([1, 2, 3], lambda j: CASE WHEN hi[j] = 1 THEN 1 WHEN lo[j] = -1 THEN -1 ELSE 0 END) AS v, list_transform([1, 2, 3], lambda j: hi[j] = 1 AND lo[j] = -1) AS odd FROM hl),
h3 AS (SELECT *, list_position(list_transform([1, 2, 3], lambda j: v[j] = 1 AND NOT odd[j]), true) AS sure FROM h2),
h4 AS (SELECT *, coalesce(sure > 0 AND list_contains(odd[1 : sure - 1], true), false) AS fixed FROM h3),
verdicts AS (SELECT token, parse_no, odd, fixed, list_transform([1, 2, 3], lambda j: CASE WHEN fixed AND odd[j] THEN -1 ELSE v[j] END) AS v FROM h4),
full_ AS (SELECT prep.token, prep.parse_no, n_parses, coalesce(v, [0, 0, 0]) AS v FROM prep LEFT JOIN verdicts ON prep.token = verdicts.token AND prep.parse_no = verdicts.parse_no),
to0 AS (SELECT token, any_value(n_parses) AS n_parses, bit_or(1 << CAST(v[1] + 1 + 3 * (v[2] + 1) + 9 * (v[3] + 1) AS INTEGER)) AS combo_max,
  CAST(max(CAST(v[1] = 1 AS INTEGER)) + 2 * max(CAST(v[2] = 1 AS INTEGER)) + 4 * max(CAST(v[3] = 1 AS INTEGER)) AS INTEGER) AS dialect_max,
  sum(CAST(v[1] = 1 AS INTEGER) + CAST(v[2] = 1 AS INTEGER) + CAST(v[3] = 1 AS INTEGER)) AS n_yes FROM full_ GROUP BY token),
toks AS (SELECT token, n_parses, combo_max, CASE WHEN bit_count(combo_max) = 1 THEN combo_max ELSE 0 END AS combo_min, dialect_max,
  CASE WHEN dialect_max IN (1, 2, 4) AND n_yes = n_parses THEN dialect_max ELSE 0 END AS dialect_min FROM to0)"""


@query("r03_reconcile", _VERD + " SELECT token, parse_no, v[1] AS v0, v[2] AS v1, v[3] AS v2, odd[1] AS odd0, odd[2] AS odd1, odd[3] AS odd2, fixed FROM verdicts")
def reconcile(spark, sf):
    return di.reconcile(_voted(spark, sf)[1]).drop("n_parses")


def _outcomes(spark, sf):
    p, v = _voted(spark, sf)
    return p, v, di.reconcile(v)


@query("r04_token_outcomes", _VERD + " SELECT * FROM toks")
def token_outcomes(spark, sf):
    p, _, verdicts = _outcomes(spark, sf)
    return di.token_outcomes(p, verdicts)


def _counts(spark, sf):
    return c.token_counts(spark, sf, ["text_name", "book"])


def _counted_and_prepared(spark, sf):
    """Token counts per book and the parses of their tokens, from one pass over the documents."""
    counts = _once(_counts(spark, sf))
    return counts, prepared(spark, sf, counts.groupBy("token").agg(F.sum("n").alias("n")))


def _by_token(p):
    """Parses or votes that are read twice, written once and spread by token again: the steps on parses group by token and more."""
    return _once(p).repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")


_BITS = ", ".join(f"CAST(coalesce(sum(n * (({s}_{b} >> {k}) & 1)), 0) AS BIGINT) AS {s}_{b}_{k}"
                  for b in ("max", "min") for s, size in (("combo", 27), ("dialect", 3)) for k in range(size))
_TEXT = _VERD + f""",
cnt AS (SELECT text_name, book, token, count(*) AS n FROM std GROUP BY ALL),
texts AS (SELECT text_name, CASE WHEN grouping(book) = 1 THEN 'Overall' ELSE 'Book ' || book END AS sub, CAST(sum(n) AS BIGINT) AS n_tokens,
  CAST(sum(CASE WHEN n_parses IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_valid, count(DISTINCT token) AS n_unique, {_BITS}
  FROM cnt LEFT JOIN toks USING (token) GROUP BY GROUPING SETS ((text_name), (text_name, book)))"""


def text_counts(spark, sf):
    counts, p = _counted_and_prepared(spark, sf)
    p = _by_token(p)
    return di.dialect_counts(counts, di.token_outcomes(p, di.reconcile(di.rule_votes(p))), keep=_once)


@query("r05_r07_text_counts", _TEXT + " SELECT * FROM texts")
def text_counts_query(spark, sf):
    return text_counts(spark, sf)


def rule_sums(spark, sf):
    counts, p = _counted_and_prepared(spark, sf)
    per = _once(di.rule_counts(counts, di.rule_outcomes(di.rule_votes(p)), ["text_name", "book"]))
    return di.with_overall(per, "text_name", "book", ["possible_max", "possible_min", *di.BOUND_COLUMNS], ["rule"])


_RULES = _OUTC + f""",
cnt AS (SELECT text_name, book, token, count(*) AS n FROM std GROUP BY ALL),
rsum AS (SELECT rule, text_name, CASE WHEN grouping(book) = 1 THEN 'Overall' ELSE 'Book ' || book END AS sub, CAST(sum(n * possible_max) AS BIGINT) AS possible_max,
  CAST(sum(n * possible_min) AS BIGINT) AS possible_min, {_BITS} FROM cnt JOIN rules USING (token) GROUP BY GROUPING SETS ((rule, text_name), (rule, text_name, book)))"""


@query("r06_rule_counts", _RULES + " SELECT * FROM rsum")
def rule_counts(spark, sf):
    return rule_sums(spark, sf)


@query("r08_long_features", _TEXT + """, u AS (UNPIVOT (SELECT * EXCLUDE (n_tokens, n_valid, n_unique) FROM texts) ON COLUMNS(* EXCLUDE (text_name, sub)) INTO NAME nm VALUE n)
SELECT text_name, sub, '' AS rule, string_split(nm, '_')[2] AS bound, string_split(nm, '_')[1] AS kind, CAST(string_split(nm, '_')[3] AS INTEGER) AS idx, n FROM u""")
def long_features(spark, sf):
    return di.as_long(text_counts(spark, sf), ["text_name", "sub"])


@query("r09_combo_codes", f"""WITH {ql.SQL_PARSES}, t AS (SELECT DISTINCT (a % 3) - 1 AS v0, (b % 3) - 1 AS v1, (d % 3) - 1 AS v2 FROM ab)
SELECT v0, v1, v2, (v0 + 1) + 3 * (v1 + 1) + 9 * (v2 + 1) AS code, v0 AS w0, v1 AS w1, v2 AS w2,
  CASE WHEN v0 = 0 AND v1 = 0 AND v2 = 0 THEN 'Any Dialect' ELSE concat_ws(', ', CASE v0 WHEN 1 THEN 'Definitely Ionic' WHEN -1 THEN 'Definitely Not Ionic' END,
   CASE v1 WHEN 1 THEN 'Definitely Aeolic' WHEN -1 THEN 'Definitely Not Aeolic' END, CASE v2 WHEN 1 THEN 'Definitely Homeric' WHEN -1 THEN 'Definitely Not Homeric' END) END AS name FROM t""")
def combo_codes(spark, sf):
    v = ql.vocabulary(spark, sf).filter(ql.HAS_PARSES)
    t = v.select((F.length("token") % 3 - 1).alias("v0"), (F.ascii("token") % 3 - 1).alias("v1"), (F.ascii(F.right("token", F.lit(1))) % 3 - 1).alias("v2")).distinct()
    t = t.withColumn("code", votes.encode(["v0", "v1", "v2"]))
    return t.select("v0", "v1", "v2", "code", *[votes.decode("code", j).alias(f"w{j}") for j in range(3)], votes.combo_name("code").alias("name"))


_TAG = _VERD + """,
tg AS (SELECT unnest([{'d': 'Ionic', 'o': v[1] = 1, 't': coalesce(contains(dialect, 'ionic'), false)}, {'d': 'Aeolic', 'o': v[2] = 1, 't': coalesce(contains(dialect, 'aeolic'), false)},
  {'d': 'Homeric', 'o': v[3] = 1, 't': coalesce(contains(dialect, 'epic'), false)}]) AS x FROM full_ JOIN prep USING (token, parse_no)),
ag AS (SELECT x.d AS dialect_name, count(*) FILTER (WHERE x.o AND x.t) AS n_both, count(*) FILTER (WHERE x.o AND NOT x.t) AS n_ours, count(*) FILTER (WHERE NOT x.o AND x.t) AS n_theirs,
  count(*) FILTER (WHERE NOT x.o AND NOT x.t) AS n_neither, count(*) AS tot FROM tg GROUP BY ALL)"""


@query("r10_tag_agreement", _TAG + " SELECT dialect_name, n_both, n_ours, n_theirs, n_neither, round(100.0 * (n_both + n_neither) / tot, 6) AS agree_percent FROM ag")
def tag_agreement(spark, sf):
    p, _, verdicts = _outcomes(spark, sf)
    return di.tag_agreement(p, verdicts).withColumn("agree_percent", c.r6("agree_percent"))


_TAGN = _TAG.replace("FROM full_ JOIN prep USING (token, parse_no))", "AS x_, n, lemma, form, dialect FROM full_ JOIN prep USING (token, parse_no) JOIN cnt0 USING (token))").replace(
    "tg AS (SELECT unnest(", "cnt0 AS (SELECT token, count(*) AS n FROM std GROUP BY token),\ntg AS (SELECT unnest(").replace(") AS x AS x_", ") AS x")
_SUMN = "CAST(coalesce(sum(n) FILTER (WHERE {}), 0) AS BIGINT)"


@query("r10_weighted_agreement", _TAGN.split("ag AS (")[0].rstrip().rstrip(",") + f""" SELECT x.d AS dialect_name, {_SUMN.format('x.o AND x.t')} AS n_both, {_SUMN.format('x.o AND NOT x.t')} AS n_ours, {_SUMN.format('NOT x.o AND x.t')} AS n_theirs,
  {_SUMN.format('NOT x.o AND NOT x.t')} AS n_neither, round(100.0 * sum(n) FILTER (WHERE x.o = x.t) / sum(n), 6) AS agree_percent FROM tg GROUP BY ALL""")
def weighted_agreement(spark, sf):
    counts, p = _counted_and_prepared(spark, sf)
    p = _by_token(p)
    return di.tag_agreement(p, di.reconcile(di.rule_votes(p)), counts).withColumn("agree_percent", c.r6("agree_percent"))


@query("r10_samples", _TAGN.split("ag AS (")[0].rstrip().rstrip(",") + """,
pr AS (SELECT x.d AS dialect_name, CASE WHEN x.o AND x.t THEN 'both' WHEN x.o THEN 'ours' ELSE 'theirs' END AS outcome, lemma, form, dialect, CAST(sum(n) AS BIGINT) AS n FROM tg WHERE x.o OR x.t GROUP BY ALL),
dr AS (SELECT *, -ln((CAST('0x' || left(md5(dialect_name || '#' || outcome || '#' || lemma || '#' || form || '#' || coalesce(dialect, '')), 12) AS BIGINT) + 0.5) / 281474976710656.0::DOUBLE) / n AS draw FROM pr)
SELECT dialect_name, outcome, lemma, form, dialect, n, place FROM (SELECT *, row_number() OVER (PARTITION BY dialect_name, outcome ORDER BY draw, lemma, form, dialect) AS place FROM dr) WHERE place <= 20""")
def samples(spark, sf):
    counts, p = _counted_and_prepared(spark, sf)
    p = _by_token(p)
    out = di.tag_samples(p, di.reconcile(di.rule_votes(p)), 20, counts)
    return out.withColumn("place", F.col("place").cast("long"))


@query("r11_collapse_parses", f"WITH {ql.SQL_PARSES} SELECT lemma, pos, \"case\", number, count(*) AS n FROM parses GROUP BY ALL")
def collapse(spark, sf):
    return di.collapse_parses(ql.parses(spark, sf), ["lemma", "pos", "case", "number"])


@query("r12_token_report", _VERD + """ SELECT token, CASE WHEN dialect_max = 0 THEN 'No clear dialect markers' ELSE concat_ws(', ',
 CASE WHEN dialect_min & 1 = 1 THEN 'Definitely Ionic' WHEN dialect_max & 1 = 1 THEN 'Possibly Ionic' END, CASE WHEN dialect_min & 2 = 2 THEN 'Definitely Aeolic' WHEN dialect_max & 2 = 2 THEN 'Possibly Aeolic' END,
 CASE WHEN dialect_min & 4 = 4 THEN 'Definitely Homeric' WHEN dialect_max & 4 = 4 THEN 'Possibly Homeric' END) END AS summary FROM toks""")
def token_report(spark, sf):
    p, _, verdicts = _outcomes(spark, sf)
    return di.token_report(di.token_outcomes(p, verdicts))


@query("r12_parse_reasons", _VERD + """, x AS (SELECT token, parse_no, rule, unnest([{'j': 1, 'n': 'Ionic', 'y': d0 = 1}, {'j': 2, 'n': 'Aeolic', 'y': d1 = 1}, {'j': 3, 'n': 'Homeric', 'y': d2 = 1}]) AS q FROM voted)
SELECT x.token, x.parse_no, q.n AS dialect_name, array_to_string(list_sort(list(DISTINCT rule)), ', ') AS reasons FROM x JOIN verdicts USING (token, parse_no) WHERE q.y AND v[q.j] = 1 GROUP BY ALL""")
def parse_reasons(spark, sf):
    v = _by_token(_voted(spark, sf)[1])
    return di.parse_reasons(v, di.reconcile(v))


@query("r13_rule_report", _RULES + " SELECT text_name, sub, rule, possible_max, possible_min, " + ", ".join(
    f"dialect_{b}_{j} AS {d.lower()}_{b}" for j, d in enumerate(votes.DIALECTS) for b in ("max", "min")) + " FROM rsum")
def rule_report(spark, sf):
    return di.rule_report(rule_sums(spark, sf), ["text_name", "sub"])


@query("r14_expectations", _VOTED + f""",
ex AS (SELECT {_sq(table.RULE_NAMES)}[CAST((length(token) * 5 + ascii(token)) % 42 + 1 AS INTEGER)] AS rule, token, CASE WHEN length(token) % 2 = 0 THEN -1 ELSE 0 END AS w, CASE ascii(token) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'Aeolic' ELSE 'Ionic' END AS expected FROM vocab WHERE substr(md5(token), 1, 1) <> '0'),
y AS (SELECT ex.rule, ex.token, w, expected, max(CASE WHEN d0 = 1 AND (w = -1 OR w = parse_no) THEN 1 ELSE 0 END) AS y0, max(CASE WHEN d1 = 1 AND (w = -1 OR w = parse_no) THEN 1 ELSE 0 END) AS y1,
  max(CASE WHEN d2 = 1 AND (w = -1 OR w = parse_no) THEN 1 ELSE 0 END) AS y2 FROM ex LEFT JOIN voted ON ex.token = voted.token AND ex.rule = voted.rule GROUP BY ALL)
SELECT rule, token, w AS parse_no, expected FROM y WHERE NOT CASE expected WHEN 'Ionic' THEN y0 = 1 WHEN 'Aeolic' THEN y1 = 1 ELSE y0 + y1 + y2 = 0 END""")
def expectations(spark, sf):
    v = ql.vocabulary(spark, sf).filter(ql.HAS_PARSES)
    k = F.ascii("token") % 3
    ex = v.select(F.element_at(F.array(*[F.lit(r) for r in table.RULE_NAMES]), (F.length("token") * 5 + F.ascii("token")) % 42 + 1).alias("rule"), "token", F.when(F.length("token") % 2 == 0, -1).otherwise(0).alias("parse_no"),
                  F.when(k == 0, "none").when(k == 1, "Aeolic").otherwise("Ionic").alias("expected"))
    return di.check_expectations(prepared(spark, sf), ex)


# ---- F-* -------------------------------------------------------------------------------------------------

def _meter_sql():
    share = lambda a, b, d="0": f"CASE WHEN {b} > 0 THEN 1.0 * {a} / ({b}) ELSE {d} END"
    out = [share(f"{g}_{i}", "n_scanned") for g, size in lf.COUNTERS[:7] for i in range(size)]
    out += [share("correption_0", "(correption_0 + correption_1)"), share("correption_0", "n_scanned")]
    out += [share(f"ictus_{i}", "n_scanned") for i in range(3)] + [share("ictus_1", "ictus_0", "1")]
    for i in (0, 2, 4):
        out += [share(f"mute_liquid_{i}", f"(mute_liquid_{i} + mute_liquid_{i + 1})"), share(f"mute_liquid_{i}", "n_scanned")]
    return out + [share(f"meyer_{i}", "n_scanned") for i in range(3)]


_METER = qs._COUNTS + ", mv AS (SELECT text_name, sub, unnest([" + ", ".join(
    f"CAST(round(CASE WHEN n_scanned > 0 THEN {e} ELSE 0 END, 6) AS DOUBLE)" for e in _meter_sql()) + "]) AS value, CAST(unnest(range(0, 51)) AS INTEGER) AS feature_idx FROM counts)"


@query("f01_meter_vector", _METER + " SELECT * FROM mv")
def meter_vector(spark, sf):
    return mx.meter_vector(qs.counts(spark, sf)).withColumn("value", c.r6("value"))


def _dialect_long(spark, sf):
    counts, p = _counted_and_prepared(spark, sf)
    p = _by_token(p)
    v = di.rule_votes(p)
    texts = _once(di.dialect_counts(counts, di.token_outcomes(p, di.reconcile(v)), keep=_once))
    per = _once(di.rule_counts(counts, di.rule_outcomes(v), ["text_name", "book"]))
    rules = di.with_overall(per, "text_name", "book", ["possible_max", "possible_min", *di.BOUND_COLUMNS], ["rule"])
    long_ = di.as_long(texts, ["text_name", "sub"]).unionByName(di.as_long(rules, ["text_name", "sub"], "rule"))
    return mx.dialect_vector(long_, texts, ["text_name", "sub"])


_PER = 30
_F2 = _VERD + f""",
cnt AS (SELECT text_name, book, token, count(*) AS n FROM std GROUP BY ALL),
texts AS (SELECT text_name, CASE WHEN grouping(book) = 1 THEN 'Overall' ELSE 'Book ' || book END AS sub, CAST(sum(CASE WHEN n_parses IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS n_valid, {_BITS}
  FROM cnt LEFT JOIN toks USING (token) GROUP BY GROUPING SETS ((text_name), (text_name, book))),
rsum AS (SELECT rule, text_name, CASE WHEN grouping(book) = 1 THEN 'Overall' ELSE 'Book ' || book END AS sub, {_BITS} FROM cnt JOIN rules USING (token) GROUP BY GROUPING SETS ((rule, text_name), (rule, text_name, book))),
al AS (SELECT '' AS rule, * EXCLUDE (n_valid) FROM texts UNION ALL SELECT * FROM rsum),
up AS (UNPIVOT al ON COLUMNS(* EXCLUDE (rule, text_name, sub)) INTO NAME nm VALUE n),
ix AS (SELECT text_name, sub, n, CAST(51 + CASE string_split(nm, '_')[2] WHEN 'max' THEN 0 ELSE {43 * _PER} END + {_PER} * (list_position({_sq(['', *table.RULE_NAMES])}, rule) - 1)
  + CASE string_split(nm, '_')[1] WHEN 'combo' THEN 0 ELSE 27 END + CAST(string_split(nm, '_')[3] AS INTEGER) AS INTEGER) AS feature_idx FROM up),
dv AS (SELECT ix.text_name, ix.sub, feature_idx, CASE WHEN n_valid > 0 THEN round(1.0 * n / n_valid, 6) ELSE 0 END AS value FROM ix JOIN texts USING (text_name, sub))"""


@query("f02_dialect_vector", _F2 + " SELECT text_name, sub, feature_idx, value FROM dv")
def dialect_vector(spark, sf):
    return _dialect_long(spark, sf).withColumn("value", c.r6("value")).select("text_name", "sub", "feature_idx", "value")


@query("f03_f05_matrix", f"""WITH m AS MATERIALIZED ({_METER} SELECT text_name, sub, feature_idx, value FROM mv), d AS MATERIALIZED ({_F2} SELECT text_name, sub, feature_idx, value FROM dv)
SELECT k.text_name, k.sub, CAST(i AS INTEGER) AS feature_idx, coalesce(u.value, 0) AS value FROM (SELECT DISTINCT text_name, sub FROM m) k CROSS JOIN range(2631) r(i)
LEFT JOIN (SELECT * FROM m UNION ALL SELECT * FROM d) u ON u.text_name = k.text_name AND u.sub = k.sub AND u.feature_idx = i""")
def matrix(spark, sf):
    """Whole matrix, cell by cell: one vector of 2631 values per row of texts and books."""
    keys = ["text_name", "sub"]
    m = mx.meter_vector(qs.counts(spark, sf)).select(*keys, "feature_idx", c.r6("value").alias("value"))
    d = _dialect_long(spark, sf).select(*keys, "feature_idx", c.r6("value").alias("value"))
    rows = mx.row_vectors(mx.assemble(m, d, keys), keys, 2631)
    return rows.select(*keys, F.posexplode("features").alias("feature_idx", "value"))


@query("f03_row_mismatch", f"""WITH {c.SQL_DOCS},
a AS (SELECT DISTINCT text_name, book FROM docs WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT text_name, book FROM docs WHERE doc_id % 2 = 1)
SELECT coalesce(a.text_name, b.text_name) AS text_name, coalesce(a.book, b.book) AS book, CASE WHEN a.book IS NULL THEN 'metre' ELSE 'dialect' END AS missing
FROM a FULL JOIN b ON a.text_name = b.text_name AND a.book = b.book WHERE a.book IS NULL OR b.book IS NULL""")
def row_mismatch(spark, sf):
    d = c.documents(spark, sf)
    return mx.assert_same_rows(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), ["text_name", "book"])


# names written out: votes of a combination, then rules by their number and title
_NAMES = f"""mt(i, name) AS (SELECT generate_subscripts(l, 1) - 1, unnest(l) FROM (SELECT
  list_transform(range(1, 6), lambda k: 'Foot ' || k || ' is spondaic') || list_transform(['Single Double', 'Double Double', 'Triple', 'Quadruple', 'Quintuple'], lambda x: 'Spondaic Runs: ' || x)
  || list_transform(range(6), lambda k: 'Some caesura at position ' || k) || list_transform(range(6), lambda k: 'Masculine caesura at position ' || k) || list_transform(range(6), lambda k: 'Feminine caesura at position ' || k)
  || list_transform(range(3), lambda k: 'Principal caesura at position ' || k) || list_transform(range(5), lambda k: 'Diaeresis at position ' || k)
  || ['Frequency correption happened when it could have', 'Overall correption frequency', 'Overall Ictus Lengthening frequency', 'Overall Ictus Lengthening frequency', 'Overall Ictus Lengthening frequency', 'Percentage of ictus lengthenings followed by space']
  || flatten(list_transform(['r/l/n/m', 'r/l', 'n/m'], lambda x: ['Mute Liquid (' || x || ') frequency in places it could have happened', 'Total Mute Liquid (' || x || ') frequency']))
  || list_transform(range(1, 4), lambda k: 'Meyer''s Law ' || k || ' frequency') AS l)),
ti(no, rule, title) AS (VALUES (0, '', ''), {', '.join(f"({k + 1}, '{r}', '" + table.RULES[r][0].replace("'", "''") + "')" for k, r in enumerate(table.RULE_NAMES))}),
cb AS (SELECT k, 'Combo [' || CASE WHEN k = 13 THEN 'Any Dialect' ELSE concat_ws(', ', CASE k % 3 WHEN 2 THEN 'Definitely Ionic' WHEN 0 THEN 'Definitely Not Ionic' END, CASE k // 3 % 3 WHEN 2 THEN 'Definitely Aeolic' WHEN 0 THEN 'Definitely Not Aeolic' END,
  CASE k // 9 WHEN 2 THEN 'Definitely Homeric' WHEN 0 THEN 'Definitely Not Homeric' END) END || ']' AS what FROM range(27) t(k) UNION ALL VALUES (27, 'Dialect Ionic'), (28, 'Dialect Aeolic'), (29, 'Dialect Homeric')),
dn AS (SELECT 51 + b * 43 * 30 + no * 30 + k AS i, what || ' frequency (' || CASE b WHEN 0 THEN 'Max' ELSE 'Min' END || CASE WHEN rule = '' THEN '' ELSE ', ' || rule || ': ' || title END || ')' AS name FROM cb, ti, range(2) t(b))"""


@query("f04_feature_names", f"""WITH {_NAMES}, x AS ({_METER} SELECT feature_idx, count(*) AS n FROM mv GROUP BY ALL), nm AS (SELECT * FROM mt UNION ALL SELECT * FROM dn)
SELECT CAST(i AS INTEGER) AS feature_idx, name AS feature, coalesce(n, 0) AS n FROM nm LEFT JOIN x ON feature_idx = i""")
def feature_names(spark, sf):
    """All 2631 names, and in how many rows of the metre half each occurs."""
    seen = mx.meter_vector(qs.counts(spark, sf)).groupBy("feature_idx").agg(F.count("*").alias("n"))
    return mx.feature_dimension(spark).join(seen, "feature_idx", "left").select("feature_idx", "feature", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
