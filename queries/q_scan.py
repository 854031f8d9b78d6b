"""S-*, L-*, A-*, E-*: scansion, line features, sums, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import common as c
from stichos.functions import phonemes as ph
from stichos.operators import evaluate as ev, line_features as lf, scansion as sc

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


KEYS = ["doc_id", "text_name", "book", "line"]


def _verses(spark, sf):
    return sc.clean_verses(c.verses(spark, sf)).withColumn("line", F.col("line").cast("long"))


# ---- the SQL side: syllables as rows, feet by joining the 32 patterns ----------------------------

_SND = "WITH " + c.SQL_VERSES + rf""",
snd AS (SELECT doc_id, text_name, book, line,
  regexp_extract_all(regexp_replace({c.sql_clean_line(c.sql_decap_line('text'))}, '([aeiouhwj])\+', '.\1', 'g'),
                     '(?:[aeou]i|[aoehw]u|[a-z])[^a-z. ]*| ') AS s FROM lines)"""
_SYL = _SND + r""",
nuc AS (SELECT *, list_filter(range(1, len(s) + 1), lambda i: NOT regexp_matches(s[i], '^[bgdzqklmncprstfxyv ]')) AS nx FROM snd),
ks AS (SELECT doc_id, text_name, book, line, s, nx, len(nx) AS n, unnest(range(1, len(nx) + 1)) AS k FROM nuc WHERE len(nx) > 0),
g AS (SELECT *, s[nx[k]] AS v, s[nx[k] + 1 : CASE WHEN k < n THEN nx[k + 1] - 1 ELSE len(s) END] AS gap FROM ks),
h AS (SELECT *, regexp_replace(v, '[^aeiouhw]', '', 'g') AS core, contains(v, '=') AS circ, list_filter(gap, lambda x: x <> ' ') AS cs,
       list_contains(gap, ' ') AS pause, coalesce(gap[1] = ' ', false) AS word_end FROM g),
i AS (SELECT *, len(cs) AS nc, left(coalesce(cs[1], ''), 1) AS c1, left(coalesce(cs[2], ''), 1) AS c2 FROM h),
j AS (SELECT *, nc = 2 AND (c1 = 'v' OR c2 = 'v') AS doublet, pause AND nc = 1 AND c1 = 'v' AS hiatus FROM i),
f AS (SELECT *, CASE WHEN k = n THEN nc >= 1 ELSE (nc >= 2 AND NOT doublet) OR (c1 IN ('z','c','y') AND (nc = 1 OR doublet)) END AS closed,
       hiatus OR (pause AND nc = 0 AND k < n) AS vsv, core IN ('h', 'w') OR circ OR len(core) > 1 AS heavy,
       CASE WHEN nc = 2 AND c1 IN ('p','b','f','k','g','x','t','d','q') THEN CASE WHEN c2 IN ('r','l') THEN 1 WHEN c2 IN ('m','n') THEN 2 ELSE 0 END ELSE 0 END AS ml FROM j),
w AS (SELECT *, lag(core) OVER o AS pcore, lag(len(gap)) OVER o AS pgap FROM f WINDOW o AS (PARTITION BY doc_id, line ORDER BY k)),
m AS (SELECT *, coalesce(pcore = 'e' AND pgap = 0, false) AS after_e,
  (k < n AND ((nc >= 2 AND (cs[1] = 'n' OR (cs[2] = 'n' AND c1 <> 'v'))) OR (nc = 1 AND cs[1] = 'n'))) OR (k = n AND nc = 1 AND cs[1] = 'n') AS n_next,
  (k < n AND ((nc >= 2 AND (cs[1] = 's' OR (cs[2] = 's' AND c1 <> 'v'))) OR (nc = 1 AND cs[1] = 's'))) OR (k = n AND nc = 1 AND cs[1] = 's') AS s_next FROM w),
mm AS (SELECT *, after_e AND core = 'w' AND (word_end OR n_next) AS m2,
  after_e AND ((core = 'w' AND (word_end OR n_next)) OR (core = 'oi' AND word_end) OR (core = 'a' AND (word_end OR s_next))) AS m5 FROM m),
lv AS (SELECT *, unnest([0, 2, 5]) AS level FROM mm),
mg AS (SELECT *, CASE level WHEN 0 THEN false WHEN 2 THEN m2 ELSE m5 END AS merged FROM lv),
md AS (SELECT *, coalesce(lead(merged) OVER (PARTITION BY doc_id, line, level ORDER BY k), false) AS eaten FROM mg),
syl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, level ORDER BY k) AS r,
  CASE WHEN merged THEN CASE WHEN vsv THEN 'U' ELSE 'L' END WHEN closed THEN CASE WHEN ml > 0 THEN 'M' ELSE 'L' END
       WHEN heavy AND NOT vsv THEN 'L' WHEN core IN ('e', 'o') AND NOT circ AND NOT (doublet AND k < n) THEN CASE WHEN pause THEN 's' ELSE 'S' END ELSE 'U' END AS q
  FROM md WHERE NOT eaten)"""
_CAND = _SYL + r""",
quant AS (SELECT doc_id, text_name, book, line, level, count(*) AS n, string_agg(q, '' ORDER BY r) AS q FROM syl GROUP BY ALL HAVING count(*) BETWEEN 12 AND 17),
passes AS (SELECT * FROM (VALUES (1, 0, 0), (2, 2, 1), (3, 0, 2), (4, 2, 2), (5, 5, 2)) t(p, level, relax)),
pat AS (SELECT string_agg(CASE WHEN (b >> (f - 1)) & 1 = 1 THEN 'D' ELSE 'S' END, '' ORDER BY f) || 'F' AS feet, sum((b >> (f - 1)) & 1) + 12 AS n
        FROM range(32) x(b), range(1, 6) y(f) GROUP BY b),
c0 AS (SELECT doc_id, line, p, relax, q, feet, list_transform(range(0, 6), lambda f: 2 * f + len(replace(left(feet, CAST(f AS INTEGER)), 'S', '')) + 1) AS st
       FROM quant JOIN passes USING (level) JOIN pat ON pat.n = quant.n),
c1 AS (SELECT *, list_transform(range(1, 7), lambda f: CASE
   WHEN feet[f] = 'D' THEN CASE WHEN regexp_full_match(substr(q, st[f], 3), '[LMU][SsU][SsU]') THEN 0
        WHEN regexp_full_match(substr(q, st[f], 3), '[LMU][SsUM][SsUM]') THEN 1 WHEN regexp_full_match(substr(q, st[f], 3), '[LMUs][SsUM][SsUM]') THEN 2 ELSE 9 END
   WHEN feet[f] = 'S' THEN CASE WHEN regexp_full_match(substr(q, st[f], 2), '[LMU][LMU]') THEN 0 WHEN regexp_full_match(substr(q, st[f], 2), '[LMUs][LMU]') THEN 2 ELSE 9 END
   ELSE CASE WHEN regexp_full_match(substr(q, st[f], 2), '[LMU].') THEN 0 WHEN regexp_full_match(substr(q, st[f], 2), '[LMUs].') THEN 2 ELSE 9 END END) AS lev FROM c0),
r6 AS (SELECT * FROM c1 WHERE list_max(lev) <= relax QUALIFY lev[6] = min(lev[6]) OVER (PARTITION BY doc_id, line, p, st[6])),
r5 AS (SELECT * FROM r6 QUALIFY lev[5] = min(lev[5]) OVER (PARTITION BY doc_id, line, p, st[5])),
r4 AS (SELECT * FROM r5 QUALIFY lev[4] = min(lev[4]) OVER (PARTITION BY doc_id, line, p, st[4])),
r3 AS (SELECT * FROM r4 QUALIFY lev[3] = min(lev[3]) OVER (PARTITION BY doc_id, line, p, st[3])),
r2 AS (SELECT * FROM r3 QUALIFY lev[2] = min(lev[2]) OVER (PARTITION BY doc_id, line, p, st[2])),
r1 AS (SELECT * FROM r2 QUALIFY lev[1] = min(lev[1]) OVER (PARTITION BY doc_id, line, p, st[1])),
per AS (SELECT doc_id, line, p, count(*) AS n_readings, min(feet) AS feet, min(q) AS q FROM r1 GROUP BY ALL),
hit AS (SELECT doc_id, line, min(p) AS scan_pass, arg_min(n_readings, p) AS n_readings, arg_min(feet, p) AS feet, arg_min(q, p) AS q FROM per GROUP BY ALL),
scans AS (SELECT lines.doc_id, text_name, book, lines.line, scan_pass, CASE WHEN n_readings = 1 THEN feet END AS feet,
          coalesce(n_readings = 1, false) AS scanned, coalesce(n_readings > 1, false) AS ambiguous, q FROM lines LEFT JOIN hit USING (doc_id, line))"""
SOUNDS, CANDIDATES = _SND, _CAND
# one row per syllable of a scanned line, with its final length and place
_RESOLVED = _CAND + r""",
ok AS (SELECT *, replace(replace(replace(feet, 'D', 'lss'), 'S', 'll'), 'F', 'lX') AS places FROM scans WHERE scanned),
res AS (SELECT ok.doc_id, ok.text_name, ok.book, ok.line, feet, r, syl.q, pause, merged, vsv, heavy, ml, doublet AND k < n AS doublet, hiatus,
   CASE substr(places, r, 1) WHEN 'l' THEN 'L' WHEN 's' THEN 'S' ELSE CASE WHEN syl.q IN ('S', 's') THEN 'S' ELSE 'L' END END AS len
   FROM ok JOIN passes ON ok.scan_pass = passes.p JOIN syl ON syl.doc_id = ok.doc_id AND syl.line = ok.line AND syl.level = passes.level)"""


@query("s01_sounds", _SND + " SELECT doc_id, line, array_to_string(s, '.') AS sounds FROM snd")
def sounds(spark, sf):
    return _verses(spark, sf).select("doc_id", "line", F.array_join(ph.sounds("text"), ".").alias("sounds"))


def _facts(verses, text):
    """Facts of the lines that have syllables. A generator of one row keeps the filter above the pattern: pushed below, it would compute it twice."""
    df = verses.withColumn("_p", F.explode(F.array(ph.cv_pattern(ph.skeleton(text, ph.STUDENT))))).filter("_p <> ''")
    return df, ph.syllable_facts("_p", ph.STUDENT)


def _classes(spark, sf, level):
    df, f = _facts(_verses(spark, sf), ph.merged_text("text", level))
    return df.select("doc_id", "line", f["n"].cast("long").alias("n"), *(f[c].alias(c if c == "classes" else f"n_{c}") for c in
                                                                       ("classes", "pauses", "corr", "ml", "dig_c", "dig_h")))


def _classes_sql(level):
    return _SYL + f""" SELECT doc_id, line, count(*) AS n, translate(string_agg(q, '' ORDER BY r), 'Ms', 'LS') AS classes,
  CAST(count(*) FILTER (WHERE pause) AS INTEGER) AS n_pauses, CAST(count(*) FILTER (WHERE vsv AND (heavy OR merged)) AS INTEGER) AS n_corr,
  CAST(count(*) FILTER (WHERE ml > 0 AND NOT merged) AS INTEGER) AS n_ml,
  CAST(count(*) FILTER (WHERE doublet AND k < n AND NOT merged) AS INTEGER) AS n_dig_c,
  CAST(count(*) FILTER (WHERE hiatus AND NOT merged) AS INTEGER) AS n_dig_h
FROM syl WHERE level = {level} GROUP BY doc_id, line"""


@query("s05_s07_syllables", _classes_sql(0))
def syllables(spark, sf):
    return _classes(spark, sf, 0)


@query("s08_synizesis_pass2", _classes_sql(2))
def synizesis2(spark, sf):
    return _classes(spark, sf, 2)


@query("s08_synizesis_pass5", _classes_sql(5))
def synizesis5(spark, sf):
    return _classes(spark, sf, 5)


# lines with marks that stand alone: within them and at their ends
_CLEAN = c.sql_clean_line(c.sql_decap_line('text'))
_MARKED = _SYL.replace(_CLEAN, "replace(" + _CLEAN + ", ' ', CASE line % 3 WHEN 0 THEN ' | ' WHEN 1 THEN ' '' ' ELSE ' = / ' END)")


@query("s08_loose_marks", _MARKED + """ SELECT doc_id, line, level, count(*) AS n, translate(string_agg(q, '' ORDER BY r), 'Ms', 'LS') AS classes FROM syl WHERE level > 0 GROUP BY doc_id, line, level""")
def loose_marks(spark, sf):
    mark = F.when(F.col("line") % 3 == 0, " | ").when(F.col("line") % 3 == 1, " ' ").otherwise(" = / ")
    v = _verses(spark, sf).withColumn("text", F.replace("text", F.lit(" "), mark)).withColumn("level", F.explode(F.array(F.lit(2), F.lit(5))))
    text = F.when(F.col("level") == 2, ph.merged_text("text", 2)).otherwise(ph.merged_text("text", 5))
    df, f = _facts(v, text)
    return df.select("doc_id", "line", "level", f["n"].cast("long").alias("n"), f["classes"].alias("classes"))


def scans(spark, sf):
    return sc.scan_lines(_verses(spark, sf))


@query("s09_s10_scans", _CAND + " SELECT doc_id, line, scan_pass, feet, scanned, ambiguous FROM scans")
def all_scans(spark, sf):
    return scans(spark, sf).select("doc_id", "line", "scan_pass", "feet", "scanned", "ambiguous")


@query("s12_resolved_lengths", _RESOLVED + " SELECT doc_id, line, feet, string_agg(len, '' ORDER BY r) AS lengths FROM res GROUP BY ALL")
def resolved(spark, sf):
    s = scans(spark, sf).filter("scanned")
    every = ph.both(F.call_function("shiftleft", F.lit(1).cast("long"), 3 * F.col("syl.n")) - 1, F.lit(ph.LANE))
    return s.select("doc_id", "line", "feet", ph.class_string(F.col("syl.n"), F.col("long"), ph.without(every, F.col("long"))).alias("lengths"))


@query("s13_one_line", _CAND + " SELECT doc_id, line, feet, scanned FROM scans WHERE line = 7")
def one_line(spark, sf):
    return sc.scan_one_line(_verses(spark, sf), 7).select("doc_id", "line", "feet", "scanned")


@query("s14_success_rate", _CAND + """,
per AS (SELECT text_name, count(*) AS n_lines, count(*) FILTER (WHERE scanned) AS n_scanned FROM scans GROUP BY ALL),
a AS (SELECT * FROM per UNION ALL SELECT 'Total', CAST(sum(n_lines) AS BIGINT), CAST(sum(n_scanned) AS BIGINT) FROM per WHERE text_name <> 'es')
SELECT *, CASE WHEN n_lines > 0 THEN round(100.0 * n_scanned / n_lines, 6) ELSE 0 END AS rate FROM a""".replace("per AS (SELECT text_name", "per2 AS (SELECT text_name").replace("FROM per UNION", "FROM per2 UNION").replace("FROM per WHERE", "FROM per2 WHERE"))
def success(spark, sf):
    return sc.success_rate(scans(spark, sf), ["text_name"], F.col("text_name") != "es").withColumn("rate", c.r6("rate"))


# ---- features -----------------------------------------------------------------------------------

_FEATS = _RESOLVED + r""",
fs AS (SELECT *, list_transform(range(0, 6), lambda f: 2 * f + len(replace(left(feet, CAST(f AS INTEGER)), 'S', '')) + 1) AS st FROM ok),
pz AS (SELECT doc_id, line, string_agg(CASE WHEN pause THEN '1' ELSE '0' END, '' ORDER BY r) AS pz FROM res GROUP BY ALL),
br AS (SELECT fs.doc_id, fs.text_name, fs.book, fs.line, feet,
  list_transform(range(1, 7), lambda f: CAST(substr(pz, st[f], 1) AS INTEGER)) AS masculine,
  list_transform(range(1, 7), lambda f: CASE WHEN feet[f] = 'D' THEN CAST(substr(pz, st[f] + 1, 1) AS INTEGER) ELSE 0 END) AS feminine,
  list_transform(range(1, 6), lambda f: CAST(substr(pz, st[f + 1] - 1, 1) AS INTEGER)) AS diaeresis FROM fs JOIN pz USING (doc_id, line)),
b2 AS (SELECT *, list_transform(range(1, 7), lambda f: greatest(masculine[f], feminine[f])) AS any_caesura,
  CASE WHEN masculine[3] = 1 THEN 0 WHEN feminine[3] = 1 THEN 1 WHEN masculine[4] = 1 THEN 2 ELSE -1 END AS principal_caesura,
  list_transform(range(1, 6), lambda f: CASE WHEN feet[f] = 'S' THEN 1 ELSE 0 END) AS spondee,
  CASE WHEN left(feet, 5) = 'SSDSS' THEN [0,1,0,0,0] WHEN left(feet, 5) = 'SSSSS' THEN [0,0,0,0,1] WHEN contains(left(feet, 5), 'SSSS') THEN [0,0,0,1,0]
       WHEN contains(left(feet, 5), 'SSS') THEN [0,0,1,0,0] WHEN contains(left(feet, 5), 'SS') THEN [1,0,0,0,0] ELSE [0,0,0,0,0] END AS run FROM br),
b3 AS (SELECT *, [CASE WHEN diaeresis[1] = 0 AND masculine[2] = 0 AND (feminine[2] = 1 OR diaeresis[2] = 1) THEN 0 ELSE 1 END,
  CASE WHEN (principal_caesura = 0 AND feminine[2] = 1) OR (principal_caesura = 2 AND feminine[3] = 1) THEN 0 ELSE 1 END,
  CASE WHEN masculine[3] = 1 AND masculine[5] = 1 AND NOT (any_caesura[4] = 1 OR feminine[3] = 1 OR diaeresis[3] = 1 OR diaeresis[4] = 1) THEN 0 ELSE 1 END] AS meyer FROM b2),
ct AS (SELECT doc_id, line,
  [count(*) FILTER (WHERE vsv AND (heavy OR merged) AND len = 'S'), count(*) FILTER (WHERE vsv AND (heavy OR merged) AND len = 'L')] AS correption,
  [count(*) FILTER (WHERE q = 's' AND len = 'L'), count(*) FILTER (WHERE q = 's' AND len = 'L' AND pause), count(*) FILTER (WHERE q = 's' AND len = 'L' AND NOT pause)] AS ictus,
  [count(*) FILTER (WHERE ml > 0 AND NOT merged AND len = 'S'), count(*) FILTER (WHERE ml > 0 AND NOT merged AND len = 'L'),
   count(*) FILTER (WHERE ml = 1 AND NOT merged AND len = 'S'), count(*) FILTER (WHERE ml = 1 AND NOT merged AND len = 'L'),
   count(*) FILTER (WHERE ml = 2 AND NOT merged AND len = 'S'), count(*) FILTER (WHERE ml = 2 AND NOT merged AND len = 'L')] AS mute_liquid,
  [count(*) FILTER (WHERE (doublet OR hiatus) AND NOT merged AND len = 'L'), count(*) FILTER (WHERE (doublet OR hiatus) AND NOT merged AND len = 'S'),
   count(*) FILTER (WHERE doublet AND NOT merged AND len = 'L'), count(*) FILTER (WHERE doublet AND NOT merged AND len = 'S'),
   count(*) FILTER (WHERE hiatus AND NOT merged AND len = 'L'), count(*) FILTER (WHERE hiatus AND NOT merged AND len = 'S')] AS digamma FROM res GROUP BY ALL),
feats AS (SELECT * FROM b3 JOIN ct USING (doc_id, line))"""

_LISTS = ("spondee", "run", "any_caesura", "masculine", "feminine", "diaeresis", "meyer", "correption", "ictus", "mute_liquid", "digamma")


@query("l01_l10_line_features", _FEATS + " SELECT doc_id, line, principal_caesura, " + ", ".join(
    f"array_to_string({x}, '') AS {x}" for x in _LISTS) + " FROM feats")
def line_features(spark, sf):
    f = lf.line_features(scans(spark, sf).filter("scanned"))
    return f.select("doc_id", "line", "principal_caesura", *[F.array_join(F.col(x).cast("array<string>"), "").alias(x) for x in _LISTS])


def _sum_sql():
    cols = []
    for g, size in lf.COUNTERS:
        for i in range(size):
            what = f"CASE WHEN principal_caesura = {i} THEN 1 ELSE 0 END" if g == "principal" else f"{g}[{i + 1}]"
            cols.append(f"CAST(coalesce(sum({what}), 0) AS BIGINT) AS {g}_{i}")
    return ", ".join(cols)


_COUNTS = _FEATS + f""",
allf AS (SELECT scans.text_name, scans.book, scanned, feats.* EXCLUDE (doc_id, line, text_name, book) FROM scans LEFT JOIN feats USING (doc_id, line)),
counts AS (SELECT text_name, CASE WHEN grouping(book) = 1 THEN 'Overall' ELSE 'Book ' || book END AS sub, count(*) AS n_lines,
  count(*) FILTER (WHERE scanned) AS n_scanned, {_sum_sql()} FROM allf GROUP BY GROUPING SETS ((text_name), (text_name, book)))"""


def counts(spark, sf):
    return lf.meter_counts(lf.line_features(scans(spark, sf)))


@query("a01_a11_meter_counts", _COUNTS + " SELECT * FROM counts")
def meter_counts(spark, sf):
    return counts(spark, sf)


def _report_sql():
    parts = []
    for g, size in lf.COUNTERS:
        step = 2 if g in ("correption", "mute_liquid", "digamma") else 1
        for i in range(0, size, step):
            total = f"{g}_{i} + {g}_{i + 1}" if step == 2 else "n_scanned"
            parts.append(f"SELECT text_name, sub, n_scanned, '{g}' AS metric, {i // step} AS place, {g}_{i} AS n, {total} AS total FROM counts")
    return (_COUNTS + ", u AS (" + " UNION ALL ".join(parts) + ") SELECT text_name, sub, metric, place, n, total, "
            "CASE WHEN total > 0 THEN round(100.0 * n / total, 6) ELSE 0 END AS percent, "
            "CASE WHEN n_scanned > 0 THEN round(1.0 * n / n_scanned, 6) ELSE 0 END AS per_line FROM u")


@query("a12_percentage_report", _report_sql())
def report(spark, sf):
    return lf.percentage_report(counts(spark, sf)).withColumns({x: c.r6(x) for x in ("percent", "per_line")})


# ---- evaluation -----------------------------------------------------------------------------------

# The other side is derived from the scans: some feet changed, some lost, some in notation.
_OTHER = _CAND + """,
other AS (SELECT *, CASE WHEN (doc_id + line) % 7 = 0 THEN 'S' || substr(feet, 2) WHEN (doc_id + line) % 5 = 0 THEN NULL
   WHEN feet IS NULL AND line % 11 = 0 THEN 'DDDDDF' ELSE feet END AS target,
   replace(replace(replace(feet, 'S', '--|'), 'D', '-uu|'), 'F', CASE WHEN line % 9 = 0 THEN '-?' ELSE '-x' END) AS notation FROM scans)"""


def _other(spark, sf):
    s = scans(spark, sf)
    odd = F.col("doc_id") + F.col("line")
    return s.select(
        *KEYS, "scanned", "feet",
        F.when(odd % 7 == 0, F.concat(F.lit("S"), F.substr("feet", F.lit(2)))).when(odd % 5 == 0, F.lit(None))
        .when(F.col("feet").isNull() & (F.col("line") % 11 == 0), "DDDDDF").otherwise(F.col("feet")).alias("target"),
        F.regexp_replace(F.replace(F.replace("feet", F.lit("S"), F.lit("--|")), F.lit("D"), F.lit("-uu|")), "F",
                         F.when(F.col("line") % 9 == 0, "-?").otherwise("-x")).alias("notation"))


@query("e01_parse_feet", _OTHER + """ SELECT doc_id, line, notation, CASE WHEN notation NOT LIKE '%?%' THEN feet END AS parsed FROM other WHERE notation IS NOT NULL""")
def parse_feet(spark, sf):
    return _other(spark, sf).filter("notation IS NOT NULL").select("doc_id", "line", "notation", ev.parse_feet("notation").alias("parsed"))


_OUT = """CASE WHEN feet IS NOT NULL AND target IS NOT NULL THEN CASE WHEN feet = target THEN 'agree' ELSE 'differ' END
 WHEN feet IS NOT NULL THEN 'theirs_failed' WHEN target IS NOT NULL THEN 'ours_failed' ELSE 'both_failed' END"""
_AGREE = ", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS n_{o}" for o in ev.OUTCOMES)


@query("e02_e03_e06_compare", _OTHER + f" SELECT doc_id, line, feet AS ours, target AS theirs, {_OUT} AS outcome FROM other")
def compare(spark, sf):
    o = _other(spark, sf).select("doc_id", "line", F.col("feet").alias("ours"), F.col("target").alias("theirs"))
    return o.withColumn("outcome", ev.outcome(F.col("ours"), F.col("theirs")))


@query("e05_all_same", _OTHER + """,
u AS (SELECT doc_id, line, feet FROM other UNION ALL SELECT doc_id, line, target FROM other)
SELECT doc_id, line, count(*) AS n_scans, (count(DISTINCT feet) <= 1 AND count(feet) IN (0, count(*))) AS same FROM u GROUP BY ALL""")
def all_same(spark, sf):
    o = _other(spark, sf)
    u = o.select("doc_id", "line", F.explode(F.array("feet", "target")).alias("feet"))
    return ev.all_same(u, ["doc_id", "line"])


@query("e07_agreement", _OTHER + f""",
k AS (SELECT text_name, {_OUT} AS outcome FROM other)
SELECT text_name, count(*) AS n_lines, {_AGREE}, round(100.0 * count(*) FILTER (WHERE outcome = 'differ') / count(*), 6) AS differ_percent FROM k GROUP BY ALL""")
def agreement(spark, sf):
    o = _other(spark, sf)
    k = o.withColumn("outcome", ev.outcome(F.col("feet"), F.col("target")))
    return ev.agreement(k, ["text_name"]).withColumn("differ_percent", c.r6("differ_percent"))
