"""V-*, P-*: row selection, components, neighbours, folds, classifiers and their reports."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from queries import common as c
from stichos.operators import folds as fo, lasso as la, learn as le, neighbours as nb
from stichos.plans import grid as gr
from stichos.rules import selectors as se
from stichos.sources import corpus

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# ---- V-*: documents stand for rows of the matrix: the source is the text, the id the part ------------------

TEXTS = [r[0] for r in corpus.MANIFEST]


def _rows(spark, sf):
    d = c.load(spark, sf, "documents")
    k = F.substr("source", F.lit(4)).cast("int") + F.col("doc_id") % 11
    return d.select("doc_id", F.element_at(F.array(*[F.lit(t) for t in TEXTS]), (k % len(TEXTS) + 1).cast("int")).alias("text_name"),
                    F.when(F.col("doc_id") % 4 == 0, "Overall").otherwise(F.concat(F.lit("Book "), (F.col("doc_id") % 48 + 1).cast("string"))).alias("sub"))


_ROWS_SQL = f"""rows AS (SELECT doc_id, ({'[' + ', '.join("'" + t + "'" for t in TEXTS) + ']'})[CAST((CAST(substr(source, 4) AS INTEGER) + doc_id % 11) % {len(TEXTS)} + 1 AS INTEGER)] AS text,
  CASE WHEN doc_id % 4 = 0 THEN 'Overall' ELSE 'Book ' || (doc_id % 48 + 1) END AS sub FROM documents), named AS (SELECT *, text || ': ' || sub AS name FROM rows)"""


def _selector_sql():
    parts = [f"SELECT '{s}' AS selector, doc_id, {se.decision(arms)} AS d FROM named" for s, arms in se.SELECTORS.items()]
    return f"""WITH {_ROWS_SQL}, u AS ({' UNION ALL '.join(parts)})
SELECT selector, string_split(d, ' ')[1] = 'test' AS is_test, string_split(d, ' ')[2] = 'show' AS show_name, CAST(string_split(d, ' ')[3] AS INTEGER) AS label,
  count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM u WHERE d <> 'skip' GROUP BY ALL"""


@query("v01_v23_selectors", _selector_sql())
def selectors(spark, sf):
    return se.select_all(_rows(spark, sf), se.SELECTORS).groupBy("selector", "is_test", "show_name", "label").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


OWN_ARMS = [("text = 'en' AND sub = 'src3'", "skip"), ("text = 'en'", "train show 0"), ("text = 'fr' AND sub <> 'src1'", "test hide 1"), ("sub = 'src7'", "train hide 2")]


@query("v00_generic_selector", f"""SELECT text_name, sub, is_test, show_name, label, count(*) AS n FROM (SELECT lang AS text_name, source AS sub,
  string_split(d, ' ')[1] = 'test' AS is_test, string_split(d, ' ')[2] = 'show' AS show_name, CAST(string_split(d, ' ')[3] AS INTEGER) AS label
  FROM (SELECT lang, source, {se.decision(OWN_ARMS)} AS d FROM (SELECT lang, source, lang AS text, source AS sub FROM documents)) WHERE d <> 'skip') GROUP BY ALL""")
def generic_selector(spark, sf):
    d = c.load(spark, sf, "documents").select(F.col("lang").alias("text_name"), F.col("source").alias("sub"))
    return se.select_rows(d, OWN_ARMS).groupBy("text_name", "sub", "is_test", "show_name", "label").agg(F.count("*").alias("n"))


# ---- P-*: embeddings stand for feature rows --------------------------------------------------------------

WIDTH = 64


def _points(spark, sf):
    return c.load(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), F.col("embedding").cast("array<double>").alias("features"), "label")


def _vectors(spark, sf):
    return le.as_vectors(_points(spark, sf))


# a label that two of the 64 numbers decide
_LABEL_SQL = "CAST(embedding[1]::DOUBLE + embedding[6]::DOUBLE > 0 AS INTEGER)"


def _marked(spark, sf):
    """Rows with that label; the fold and the inner fold follow from the id."""
    x = F.col("features")
    return _points(spark, sf).withColumn("label", (x[0] + x[5] > 0).cast("int")).withColumn("fold", (F.col("name") % 5).cast("int"))


def _moments(spark, sf):
    return la.fold_moments(_marked(spark, sf), fold=F.col("fold"), inner=F.col("name") % 3)


_Z = f"""z AS (SELECT vec_id % 5 AS fold, vec_id % 3 AS inner_fold, vec_id, list_append(list_append(embedding::DOUBLE[], {_LABEL_SQL}::DOUBLE), 1.0) AS z FROM embeddings),
u AS MATERIALIZED (SELECT fold, inner_fold, vec_id, unnest(z) AS x, generate_subscripts(z, 1) - 1 AS i FROM z)"""


@query("p01_fold_moments", f"""WITH {_Z} SELECT CAST(a.fold AS VARCHAR) AS fold, CAST(a.inner_fold AS INTEGER) AS inner, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(sum(a.x * b.x), 6) AS value
FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL""")
def fold_moments(spark, sf):
    return la.moment_cells(_moments(spark, sf)).withColumn("value", c.r6("value"))


FRACTIONS = [0.5, 0.1, 0.02]


@query("p01_lasso_at_penalties", f"""WITH RECURSIVE {_Z},
g AS MATERIALIZED (SELECT a.fold, a.i, b.i AS j, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.vec_id = b.vec_id GROUP BY ALL),
f AS (SELECT unnest([0, 1, 2, 3, 4, NULL]) AS f),
t AS MATERIALIZED (SELECT f, i, j, sum(s) AS s FROM g, f WHERE f IS NULL OR fold <> f GROUP BY ALL),
n AS (SELECT f, s AS n FROM t WHERE i = 65 AND j = 65), mu AS (SELECT t.f, i, s / n AS m FROM t JOIN n ON t.f IS NOT DISTINCT FROM n.f WHERE j = 65),
cv AS MATERIALIZED (SELECT t.f, t.i, t.j, s / n - a.m * b.m AS x FROM t JOIN n ON t.f IS NOT DISTINCT FROM n.f JOIN mu a ON a.f IS NOT DISTINCT FROM t.f AND a.i = t.i JOIN mu b ON b.f IS NOT DISTINCT FROM t.f AND b.i = t.j),
cr AS MATERIALIZED (SELECT coalesce(f, -1) AS f, j, list(x ORDER BY i) AS col FROM cv WHERE i < 64 AND j <= 64 GROUP BY ALL),
base AS (SELECT f, col AS cross_, unnest({FRACTIONS}::DOUBLE[]) * list_max(list_transform(col, lambda x: abs(x))) AS pen FROM cr WHERE j = 64),
st AS (SELECT f, pen, 0 AS step, list_transform(range(64), lambda i: 0::DOUBLE) AS b, cross_ AS g FROM base
 UNION ALL SELECT f, pen, step + 1, list_transform(range(1, 65), lambda i: CASE WHEN i = k THEN nb ELSE b[i] END), list_transform(range(1, 65), lambda i: g[i] - col[i] * (nb - b[k])) FROM (
  SELECT st.f, pen, step, b, g, col, step % 64 + 1 AS k, sign(g[step % 64 + 1] + col[step % 64 + 1] * b[step % 64 + 1]) * greatest(abs(g[step % 64 + 1] + col[step % 64 + 1] * b[step % 64 + 1]) - pen, 0::DOUBLE) / col[step % 64 + 1] AS nb
  FROM st JOIN cr ON cr.f = st.f AND cr.j = step % 64 WHERE step < 64 * 60))
SELECT CASE WHEN f >= 0 THEN CAST(f AS VARCHAR) END AS fold, round(pen, 6) AS penalty, CAST(unnest(range(64)) AS INTEGER) AS feature_idx, round(unnest(b), 6) AS coefficient FROM st WHERE step = 64 * 60""")
def lasso_at_penalties(spark, sf):
    out = la.lasso_by_fold(_moments(spark, sf), fractions=FRACTIONS)
    return out.select("fold", c.r6("penalty").alias("penalty"), F.posexplode("coefficients").alias("feature_idx", "coefficient")).withColumn("coefficient", c.r6("coefficient"))


@query("p01_lasso_by_fold")
def lasso_by_fold(spark, sf):
    return la.lasso_by_fold(_moments(spark, sf)).select("fold", c.r6("penalty").alias("penalty"), F.transform("coefficients", lambda x: F.round(x, 6)).alias("coefficients"))


@query("p01_lasso_selection")
def lasso(spark, sf):
    names = spark.range(WIDTH).select(F.col("id").cast("int").alias("feature_idx"), F.concat(F.lit("dim "), F.col("id")).alias("feature"))
    return le.selected_features(_marked(spark, sf), names, 0.15).withColumn("coefficient", c.r6("coefficient"))


def _pca_sql(train: str, k: int, squarings: int = 16) -> str:
    """The k leading eigenvectors of the covariance matrix of the rows of `train`: squared until one direction is left, then taken out."""
    parts = [f"""e AS (SELECT vec_id AS name, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
mu AS (SELECT i, avg(x) AS m FROM e WHERE {train} GROUP BY i), cx AS MATERIALIZED (SELECT name, e.i, x - m AS x FROM e JOIN mu USING (i)),
a0 AS MATERIALIZED (SELECT p.i, q.i AS j, avg(p.x * q.x) AS x FROM cx p JOIN cx q ON p.name = q.name WHERE p.{train} GROUP BY ALL)"""]
    for n in range(k):
        parts.append(f"b{n}_0 AS MATERIALIZED (SELECT i, j, x / (SELECT sum(x) FROM a{n} WHERE i = j) AS x FROM a{n})")
        for s in range(squarings):
            parts.append(f"b{n}_{s + 1} AS MATERIALIZED (SELECT p.i, q.j, sum(p.x * q.x) / (SELECT sum(x * x) FROM b{n}_{s}) AS x FROM b{n}_{s} p JOIN b{n}_{s} q ON p.j = q.i GROUP BY ALL)")
        last = f"b{n}_{squarings}"
        parts.append(f"w{n} AS MATERIALIZED (SELECT i, x / sqrt((SELECT max(x) FROM {last} WHERE i = j)) AS w FROM {last} WHERE j = (SELECT arg_max(i, x) FROM {last} WHERE i = j))")
        parts.append(f"a{n + 1} AS MATERIALIZED (SELECT a.i, a.j, a.x - l * p.w * q.w AS x FROM a{n} a JOIN w{n} p ON p.i = a.i JOIN w{n} q ON q.i = a.j, (SELECT sum(a.x * p.w * q.w) AS l FROM a{n} a JOIN w{n} p ON p.i = a.i JOIN w{n} q ON q.i = a.j))")
    return ",\n".join(parts)


@query("p02_p03_coordinates", "WITH " + _pca_sql("name % 5 <> 0", 4) + ",\n" + ",\n".join(
    f"k{n} AS (SELECT name, sum(x * w) AS p FROM cx JOIN w{n} USING (i) GROUP BY name), s{n} AS (SELECT name, round(p * (SELECT sign(arg_max(p, abs(p))) FROM k{n}), 4) AS pc{n + 1} FROM k{n})" for n in range(4))
    + " SELECT vec_id AS name, label, vec_id % 5 = 0 AS is_test, pc1, pc2, pc3, pc4 FROM embeddings JOIN s0 ON s0.name = vec_id JOIN s1 ON s1.name = vec_id JOIN s2 ON s2.name = vec_id JOIN s3 ON s3.name = vec_id")
def coordinates(spark, sf):
    v = _vectors(spark, sf)
    out = le.project(v.filter("name % 5 <> 0"), v.filter("name % 5 = 0"), 4, ["name", "label"])
    # the sign of a component is free: its largest coordinate counts as positive
    signs = out.agg(*[F.signum(F.max_by(f"pc{i}", F.abs(f"pc{i}"))).alias(f"s{i}") for i in range(1, 5)])
    out = out.crossJoin(F.broadcast(signs))
    return out.select("name", "label", "is_test", *[F.round(F.col(f"pc{i}") * F.col(f"s{i}"), 4).alias(f"pc{i}") for i in range(1, 5)])


@query("p04_loadings", "WITH " + _pca_sql("name IS NOT NULL", 3) + ",\nl AS (" + " UNION ALL ".join(f"SELECT {n} AS component, i, w * (SELECT sign(arg_max(w, abs(w))) FROM w{n}) AS w FROM w{n}" for n in range(3))
       + ") SELECT component, CAST(i AS INTEGER) AS feature_idx, round(w, 4) AS loading, row_number() OVER (PARTITION BY component ORDER BY abs(w) DESC) AS rank FROM l")
def loadings(spark, sf):
    out = le.loadings(_vectors(spark, sf), 3)
    signs = out.filter("rank = 1").select("component", F.signum("loading").alias("_sign"))
    return out.join(F.broadcast(signs), "component").select("component", "feature_idx", F.round(F.col("loading") * F.col("_sign"), 4).alias("loading"), F.col("rank").cast("long").alias("rank"))


@query("p05_contributions", """WITH e AS (SELECT vec_id AS name, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
l AS (SELECT c AS component, CAST(f AS INTEGER) AS feature_idx, ((f * 7 + c * 13) % 31 - 15) / 16.0 AS loading FROM range(64) t(f), range(3) u(c)),
k AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature_idx) AS rank FROM l WHERE loading <> 0)
SELECT name, CAST(component AS INTEGER) AS component, feature_idx, rank, round(CAST(v AS DOUBLE) * loading, 6) AS part,
  round(sum(CAST(v AS DOUBLE) * loading) OVER (PARTITION BY component, name ORDER BY rank ROWS UNBOUNDED PRECEDING), 6) AS running FROM e JOIN k ON e.f = k.feature_idx""")
def contributions(spark, sf):
    long_ = _points(spark, sf).select("name", F.posexplode("features").alias("feature_idx", "value"))
    f, comp = F.col("feature_idx"), F.col("component")
    load = (long_.select("feature_idx").distinct().withColumn("component", F.explode(F.array(*[F.lit(i) for i in range(3)])))
            .withColumn("loading", ((f * 7 + comp * 13) % 31 - 15) / 16.0).filter("loading <> 0"))
    from pyspark.sql import Window
    load = load.withColumn("rank", F.row_number().over(Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature_idx")))
    out = le.contributions(long_, load, ["name"])
    return out.select("name", "component", "feature_idx", F.col("rank").cast("long").alias("rank"), c.r6("part").alias("part"), c.r6("running").alias("running"))


@query("p06_scaling", """WITH e AS (SELECT vec_id AS name, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
s AS (SELECT f, avg(v) AS m, stddev_samp(v) AS d FROM e GROUP BY f)
SELECT name, CAST(f AS INTEGER) AS feature_idx, round((v - m) / d, 6) AS scaled FROM e JOIN s USING (f)""")
def scaling(spark, sf):
    v = _vectors(spark, sf)
    out = le.scaler().fit(v).transform(v)
    return out.select("name", F.posexplode(vector_to_array("scaled")).alias("feature_idx", "scaled")).withColumn("scaled", c.r6("scaled"))


_KNN = """WITH e AS (SELECT vec_id AS name, embedding::DOUBLE[] AS v, label, vec_id % 5 AS fold FROM embeddings),
d AS (SELECT a.name, b.name AS near, b.label AS nl, list_distance(a.v, b.v) AS dist FROM e a JOIN e b ON a.fold <> b.fold),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, near) AS rank FROM d QUALIFY rank <= 5)"""


def _near(spark, sf, k=5):
    return nb.nearest(_points(spark, sf).withColumn("fold", F.col("name") % 5), k)


@query("p11_nearest", _KNN + " SELECT name, near, nl AS near_label, round(dist, 6) AS distance, rank FROM k")
def nearest(spark, sf):
    return _near(spark, sf).withColumn("distance", c.r6("distance")).withColumn("rank", F.col("rank").cast("long"))


@query("p11_knn_vote", _KNN + """, w AS (SELECT kk, name, nl, count(*) AS n FROM k, (VALUES (2), (3), (4), (5)) t(kk) WHERE rank <= kk GROUP BY ALL)
SELECT kk AS k, name, arg_max(nl, n * 1000 - nl) AS pred FROM w GROUP BY ALL""")
def knn_vote(spark, sf):
    return nb.vote(_near(spark, sf), list(le.NEIGHBOURS), False)


@query("p12_knn_weighted", _KNN + """, w AS (SELECT kk, name, nl, sum(CASE WHEN dist > 0 THEN 1 / dist ELSE 1e12 END) AS n FROM k, (VALUES (2), (3), (4), (5)) t(kk) WHERE rank <= kk GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY kk, name ORDER BY n DESC, nl) AS o FROM w) SELECT kk AS k, name, nl AS pred FROM r WHERE o = 1""")
def knn_weighted(spark, sf):
    return nb.vote(_near(spark, sf), list(le.NEIGHBOURS), True)


@query("p14_random_splits", """SELECT CAST(split AS INTEGER) AS split, doc_id, r <= ceil(n * 0.1) AS is_test FROM (SELECT split, doc_id,
  row_number() OVER (PARTITION BY split ORDER BY md5(doc_id || '#' || split)) AS r, count(*) OVER (PARTITION BY split) AS n FROM documents, range(5) t(split))""")
def random_splits(spark, sf):
    return fo.random_splits(c.load(spark, sf, "documents"), "doc_id")


@query("p15_stratified_folds", """SELECT doc_id, lang, CAST(ntile(5) OVER (PARTITION BY lang ORDER BY md5(doc_id || '#10')) AS INTEGER) AS fold FROM documents""")
def stratified(spark, sf):
    return fo.stratified_folds(c.load(spark, sf, "documents"), "doc_id", "lang")


@query("p16_leave_one_out", "SELECT doc_id, doc_id AS fold FROM documents")
def leave_one_out(spark, sf):
    return fo.leave_one_out(c.load(spark, sf, "documents"), "doc_id")


@query("p17_leave_group_out", "SELECT doc_id, CASE WHEN lang IN ('en', 'fr') THEN lang END AS fold FROM documents")
def leave_group_out(spark, sf):
    return fo.leave_group_out(c.load(spark, sf, "documents"), "doc_id", "lang", ["en", "fr"])


# P-7 ... P-10, P-13, P-18 on all vectors and two folds
CELLS = [le.Cell(0.0, "scale", "logistic"), le.Cell(0.0, "pca4", "svm"), le.Cell(0.0, "pca3", "rbf"),
         le.Cell(0.0, "pca2", "forest"), le.Cell(0.0, "pca4", "knn3"), le.Cell(0.0, "pca4", "knn3w")]


def _grid(spark, sf, cells, name):
    rows = _marked(spark, sf).withColumn("fold", (F.col("name") % 2).cast("int"))
    return gr.prediction_log(le.as_vectors(rows), [0, 1], cells, WIDTH, f"{c.scratch(spark, 'grid', sf)}/{name}", steps=20)


@query("p07_p10_p18_prediction_log")
def prediction_log(spark, sf):
    return _grid(spark, sf, CELLS, "six")


_KNN_CELLS = [cell for cell in le.grid([0.0]) if cell.prep == "scale" and cell.classifier.startswith("knn")]


@query("p13_grid_votes", f"""WITH r AS (SELECT vec_id AS name, vec_id % 2 AS fold, {_LABEL_SQL} AS label, embedding::DOUBLE[] AS v FROM embeddings),
e AS (SELECT name, fold, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM r), s AS (SELECT 1 - fold AS fold, i, avg(x) AS m, stddev_samp(x) AS d FROM e GROUP BY fold, i),
p AS (SELECT s.fold, name, e.fold = s.fold AS tested, list((x - m) / d ORDER BY e.i) AS v FROM e JOIN s USING (i) GROUP BY ALL),
d AS (SELECT q.fold, q.name, t.name AS near, list_distance(q.v, t.v) AS dist FROM p q JOIN p t ON q.fold = t.fold AND q.tested AND NOT t.tested),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY dist, near) AS rank FROM d QUALIFY rank <= 5),
w AS (SELECT kk, weighted, k.fold, k.name, r.label AS nl, sum(CASE WHEN weighted THEN CASE WHEN dist > 0 THEN 1 / dist ELSE 1e12 END ELSE 1 END) AS n FROM k JOIN r ON r.name = k.near, (VALUES (2), (3), (4), (5)) t(kk), (VALUES (true), (false)) u(weighted) WHERE rank <= kk GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY kk, weighted, name ORDER BY n DESC, nl) AS o FROM w)
SELECT 'all -> scale -> knn' || kk || CASE WHEN weighted THEN 'w' ELSE '' END AS cell, CAST(o.fold AS VARCHAR) AS fold, o.name, r.label, nl AS pred FROM o JOIN r USING (name) WHERE o = 1""")
def grid_votes(spark, sf):
    return _grid(spark, sf, _KNN_CELLS, "votes")


@query("p13_p18_grid")
def whole_grid(spark, sf):
    return _grid(spark, sf, le.grid(), "all")


@query("p19_grid_accuracy")
def grid_accuracy(spark, sf):
    return le.mean_accuracy(whole_grid(spark, sf)).withColumn("mean_accuracy", c.r6("mean_accuracy"))


@query("p20_grid_failures")
def grid_failures(spark, sf):
    return le.failures_by_row(whole_grid(spark, sf)).withColumn("failed_percent", c.r6("failed_percent"))


# the log of the reports is derived: rows are vectors, cells and folds are numbers
_LOG = """log AS (SELECT 'cell ' || c AS cell, CAST(vec_id % 5 AS VARCHAR) AS fold, vec_id AS name, label, CAST(CASE WHEN (vec_id * 7 + c * 3) % 4 = 0 THEN (label + c) % 10 ELSE label END AS INTEGER) AS pred
  FROM embeddings, range(6) t(c))"""


def _log(spark, sf):
    e = c.load(spark, sf, "embeddings").withColumn("c", F.explode(F.array(*[F.lit(i) for i in range(6)])))
    return e.select(F.concat(F.lit("cell "), F.col("c").cast("string")).alias("cell"), (F.col("vec_id") % 5).cast("string").alias("fold"), F.col("vec_id").alias("name"), "label",
                    F.when((F.col("vec_id") * 7 + F.col("c") * 3) % 4 == 0, (F.col("label") + F.col("c")) % 10).otherwise(F.col("label")).cast("int").alias("pred"))


@query("p19_accuracy", f"WITH {_LOG} SELECT cell, fold, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_rows FROM log GROUP BY ALL")
def accuracy(spark, sf):
    return le.accuracy(_log(spark, sf)).withColumn("accuracy", c.r6("accuracy"))


@query("p19_mean_accuracy", f"""WITH {_LOG}, a AS (SELECT cell, fold, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS a FROM log GROUP BY ALL), m AS (SELECT cell, avg(a) AS m FROM a GROUP BY ALL)
SELECT cell, round(m, 6) AS mean_accuracy FROM m UNION ALL SELECT 'Overall', round(avg(m), 6) FROM m""")
def mean_accuracy(spark, sf):
    return le.mean_accuracy(_log(spark, sf)).withColumn("mean_accuracy", c.r6("mean_accuracy"))


@query("p14_prep_averages", f"""WITH {_LOG}, m AS (SELECT cell, avg(a) AS a FROM (SELECT cell, fold, avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END) AS a FROM log GROUP BY ALL) GROUP BY cell),
k AS (SELECT a, CAST(cell[6] AS INTEGER) AS c FROM m)
SELECT 'select ' || (c % 2) AS selection, 'prep ' || (c // 3) AS prep, round(avg(a), 6) AS mean_accuracy, count(*) AS n_cells FROM k GROUP BY ALL
UNION ALL SELECT 'Total', '', round(avg(a), 6), count(*) FROM k""")
def prep_averages(spark, sf):
    k = F.substr("cell", F.lit(6)).cast("int")
    name = F.concat_ws(" -> ", F.concat(F.lit("select "), (k % 2).cast("string")), F.concat(F.lit("prep "), F.floor(k / 3).cast("string")), F.col("cell"))
    return le.prep_averages(_log(spark, sf).withColumn("cell", name)).withColumn("mean_accuracy", c.r6("mean_accuracy"))


@query("p19_mismatches", f"WITH {_LOG} SELECT * FROM log WHERE pred <> label")
def mismatches(spark, sf):
    return le.mismatches(_log(spark, sf))


_FAIL = """f AS (SELECT name, count(*) AS n_cells, count(*) FILTER (WHERE pred <> label) AS n_failed,
  coalesce(array_to_string(list_sort(list(DISTINCT cell) FILTER (WHERE pred <> label)), ', '), '') AS failed_on FROM log GROUP BY name)"""


@query("p20_failures", f"WITH {_LOG}, {_FAIL} SELECT *, round(100.0 * n_failed / n_cells, 6) AS failed_percent FROM f")
def failures(spark, sf):
    return le.failures_by_row(_log(spark, sf)).withColumn("failed_percent", c.r6("failed_percent"))


@query("p21_side_by_side", f"""WITH {_LOG}, p AS (SELECT name, CAST(cell[6] AS INTEGER) AS k, pred <> label AS bad FROM log)
SELECT name, round(100.0 * count(*) FILTER (WHERE bad AND k < 2) / 2, 6) AS folds, round(100.0 * count(*) FILTER (WHERE bad AND k IN (2, 3)) / 2, 6) AS one_out, round(100.0 * count(*) FILTER (WHERE bad AND k > 3) / 2, 6) AS group_out FROM p GROUP BY name""")
def side_by_side(spark, sf):
    log = _log(spark, sf)
    part = lambda *cells: le.failures_by_row(log.filter(F.col("cell").isin(*cells)))
    out = le.side_by_side({"folds": part("cell 0", "cell 1"), "one_out": part("cell 2", "cell 3"), "group_out": part("cell 4", "cell 5")})
    return out.select("name", *[c.r6(x).alias(x) for x in ("folds", "one_out", "group_out")])


@query("p21_aligned_books", f"""WITH {c.SQL_DOCS} SELECT book, max(CASE WHEN text_name = 'en' THEN k END) AS en_longest, max(CASE WHEN text_name = 'en' THEN n END) AS en_n_docs,
  max(CASE WHEN text_name = 'fr' THEN k END) AS fr_longest, max(CASE WHEN text_name = 'fr' THEN n END) AS fr_n_docs
FROM (SELECT text_name, book, max(length(text)) AS k, count(*) AS n FROM docs GROUP BY ALL) WHERE text_name IN ('en', 'fr') GROUP BY book""")
def aligned(spark, sf):
    t = c.documents(spark, sf).groupBy("text_name", "book").agg(F.max(F.length("text")).cast("long").alias("longest"), F.count("*").alias("n_docs"))
    return le.aligned_by_book(t, ["en", "fr"], ["longest", "n_docs"])
