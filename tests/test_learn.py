"""Neighbours, lasso and the grid against brute force."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from stichos.operators import lasso as la, learn as le, neighbours as nb
from stichos.plans import grid as gr


# ---- neighbours ----------------------------------------------------------------------------------------------

def brute(rows, k):
    out = []
    for key, v, _, fold in rows:
        if fold is not None:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), other, label) for other, w, label, f in rows if f != fold)
            out += [(key, other, label, rank + 1, round(d, 9)) for rank, (d, other, label) in enumerate(near[:k])]
    return sorted(out)


def found(spark, rows, k, **kw):
    df = spark.createDataFrame(rows, "name int, features array<double>, label int, fold string")
    return sorted((r.name, r.near, r.near_label, r["rank"], round(r.distance, 9)) for r in nb.nearest(df, k, **kw).collect())


@pytest.mark.parametrize("kind", ["even", "clusters", "copies", "grid"])
def test_nearest_equals_brute_force(spark, kind):
    rng = np.random.default_rng(7)
    n = 300
    if kind == "even":
        data = rng.normal(size=(n, 5))
    elif kind == "grid":                                               # many equal distances
        data = rng.integers(0, 4, size=(n, 3)).astype(float)
    else:
        data = rng.normal(scale=20, size=(8, 4))[rng.integers(0, 8, n)] + rng.normal(scale=0.1, size=(n, 4))
        if kind == "copies":
            data[: n // 3] = data[0]                                   # a third of the rows are one vector
    rows = [(i, data[i].tolist(), int(i % 4), [None, "a", "b", "c"][i % 4]) for i in range(n)]
    assert found(spark, rows, 5, rows_per_block=16, pivots=12) == brute(rows, 5)


def test_few_rows_and_none(spark):
    rows = [(1, [0.0, 1.0], 3, "a"), (2, [0.0, 2.0], 4, "b"), (3, [5.0, 2.0], 5, "a")]
    assert found(spark, rows, 4) == brute(rows, 4)
    assert found(spark, [], 2) == []
    assert found(spark, [(1, [1.0], 1, "a"), (2, [1.0], 1, "a")], 2) == []


def test_rows_are_sent_to_rings_that_can_win(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n, sent = 2000, []
    data = rng.normal(scale=100, size=(40, 6))[rng.integers(0, 40, n)] + rng.normal(scale=0.5, size=(n, 6))
    df = spark.createDataFrame([(i, data[i].tolist(), 0, str(i % 2)) for i in range(n)], "name int, features array<double>, label int, fold string")
    inner = nb._search

    def counted(visits, *args):
        sent.append(visits.count())
        return inner(visits, *args)

    monkeypatch.setattr(nb, "_search", counted)
    assert nb.nearest(df, 3, rows_per_block=128).count() == 3 * n
    # about 60 cells could be asked; two are at first, and few are left
    assert sent[0] == 2 * n and sent[1] < 12 * n


@pytest.mark.parametrize("kind", ["even", "far", "near", "one fold", "equal"])
def test_products_leave_the_rows_that_win(kind):
    """Several blocks of both sides, against distances measured one by one."""
    rng = np.random.default_rng(3)
    x, y, k = rng.normal(size=(1100, 6)), rng.normal(size=(8300, 6)), 3
    own, folds = rng.integers(0, 3, len(x)), rng.integers(0, 3, len(y))
    if kind == "far":
        x, y = x + 1e4, y + 1e4                                        # far from zero, near to each other
    elif kind == "near":
        x[:500] = y[:500] + 1e-9
    elif kind == "one fold":
        folds[:8250] = own[:] = 1                                      # the first block holds no row that trains
    elif kind == "equal":
        x, y = np.sign(x), np.sign(y)                                  # many equal distances
    q, t, d = nb.closest(x, y, own, folds, np.full(len(x), np.inf), k)
    tried = rng.choice(len(x), 60, False)
    for i in tried:
        want = ((y - x[i]) ** 2).sum(axis=1)
        want[folds == own[i]] = np.inf
        first = np.argsort(want, kind="stable")[:k]
        assert t[q == i].tolist() == first.tolist() and d[q == i].tolist() == want[first].tolist()
    # a bound that holds leaves the same rows
    farthest = np.sqrt(np.array([d[q == i].max() for i in range(len(x))]))
    assert all((a == b).all() for a, b in zip((q, t, d), nb.closest(x, y, own, folds, farthest, k)))


# ---- lasso ---------------------------------------------------------------------------------------------------

def data(spark, n=400, width=12, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)) * rng.uniform(0.2, 3, width) + rng.normal(size=width)
    y = 2 * x[:, 0] - 0.7 * x[:, 3] + 0.05 * x[:, 5] + rng.normal(scale=0.3, size=n)
    rows = [(i, x[i].tolist(), float(y[i]), str(i % 4), i % 3) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "name int, features array<double>, label double, fold string, inner int")


def test_moments_of_large_and_small_groups(spark):
    x, y, df = data(spark, 97)
    z = np.column_stack([x, y, np.ones(len(y))])
    fold = F.when(F.col("name") < 3, F.col("name").cast("string")).when(F.col("name") < 60, "big")
    for salts in (1, 4):
        got = la.moment_cells(la.fold_moments(df, fold=fold, inner=F.col("inner"), salts=salts)).collect()
        for r in got:
            mine = [i for i in range(97) if i % 3 == r.inner and r.fold == (str(i) if i < 3 else "big" if i < 60 else None)]
            assert r.value == pytest.approx((z[mine, r.i] * z[mine, r.j]).sum(), abs=1e-8)
        assert {r.fold for r in got} == {"0", "1", "2", "big", None}
    total = la.total_moments(la.fold_moments(df, fold=fold, inner=F.col("inner")))
    assert sorted(total) == [0, 1, 2] and np.allclose(sum(total.values()), z.T @ z)


def test_coefficients_equal_another_solver(spark):
    x, y, df = data(spark)
    z = np.column_stack([x, y, np.ones(len(y))])
    for penalty in (1.0, 0.1, 0.01):
        model = LinearRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, tol=1e-12, maxIter=2000).fit(le.as_vectors(df))
        assert la.path(z.T @ z, np.array([penalty]))[0] == pytest.approx(model.coefficients.toArray(), abs=1e-4)


def test_optimality_along_the_path(spark):
    x, y, _ = data(spark)
    x = np.column_stack([x, x[:, 0], np.ones(len(y))])                 # a column twice and a constant one
    z = np.column_stack([x, y, np.ones(len(y))])
    cov, cross, _, _ = la.centred(z.T @ z)
    at = la.penalties(cross, 30)
    betas = la.path(z.T @ z, at)
    assert not betas[0].any() and betas[-1].any()
    for penalty, beta in zip(at, betas):
        gradient = cross - cov @ beta
        assert (np.abs(gradient) <= penalty + 1e-7).all()
        kept = beta != 0
        assert gradient[kept] == pytest.approx(penalty * np.sign(beta[kept]), abs=1e-7)


def test_cross_validation_per_fold(spark):
    x, y, df = data(spark)
    got = {r.fold: r for r in la.lasso_by_fold(la.fold_moments(df, fold=F.col("fold"), inner=F.col("inner")), steps=20).collect()}
    assert set(got) == {"0", "1", "2", "3", None}
    for fold, r in got.items():
        rows = [i for i in range(len(y)) if str(i % 4) != fold]
        part = lambda keep: (x[keep], y[keep])
        xs, ys = part(rows)
        at = np.abs(((xs - xs.mean(0)) * (ys - ys.mean())[:, None]).mean(0)).max() * 1e-3 ** (np.arange(20) / 19)
        errors = np.zeros(20)
        for no in range(3):
            xt, yt = part([i for i in rows if i % 3 != no])
            xv, yv = part([i for i in rows if i % 3 == no])
            z = np.column_stack([xt, yt, np.ones(len(yt))])
            for k, beta in enumerate(la.path(z.T @ z, at)):
                errors[k] += ((yv - yt.mean() - (xv - xt.mean(0)) @ beta) ** 2).mean()
        assert r.penalty == pytest.approx(at[errors.argmin()])
    assert le.select_features(np.array(got[None].coefficients), 0.4) == [0, 3]
    assert le.select_features(le.lasso_coefficients(df), 0.4) == [0, 3]


def test_lasso_without_a_signal(spark):
    df = spark.createDataFrame([([1.0, 2.0], 5.0), ([2.0, 2.0], 5.0)], "features array<double>, label double")
    assert le.lasso_coefficients(df).tolist() == [0.0, 0.0]
    empty = la.fold_moments(df.filter("label < 0"))
    assert la.lasso_by_fold(empty).collect() == []


# ---- the grid ------------------------------------------------------------------------------------------------

def test_grid_has_all_cells():
    cells = le.grid()
    assert len(cells) == len({c.name for c in cells}) == 189


def test_grid_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, (rng.normal(size=4) + 2 * (i % 2)).tolist(), i % 2, i // 2 % 2) for i in range(60)], "name int, features array<double>, label int, fold int")
    cells = [le.Cell(0.0, "scale", "logistic"), le.Cell(0.0, "scale", "knn3"), le.Cell(0.0, "scale", "knn3w"), le.Cell(0.15, "pca2", "forest"),
             le.Cell(0.15, "pca4", "svm"), le.Cell(0.4, "pca3", "svm")]
    runs, inner = [], gr.predictions

    def stops(table, fold, left, *args):
        runs.append((fold, left))
        if len(runs) == 2:
            raise RuntimeError("executor lost")
        return inner(table, fold, left, *args)

    folder = str(tmp_path / "grid")
    monkeypatch.setattr(gr, "predictions", stops)
    with pytest.raises(RuntimeError):
        gr.prediction_log(le.as_vectors(rows), [0, 1], cells, 4, folder, jobs=1)
    done = {p for p in (tmp_path / "grid" / "log").rglob("_SUCCESS")}
    stamps = {p: p.stat().st_mtime_ns for p in done}
    assert done and len(done) < 12
    log = gr.prediction_log(le.as_vectors(rows), [0, 1], cells, 4, folder, jobs=2).collect()
    assert all(p.stat().st_mtime_ns == t for p, t in stamps.items())
    assert len(log) == 60 * len(cells) and {r.fold for r in log} == {"0", "1"}
    assert len({(r.cell, r.name) for r in log}) == len(log)
    before = len(runs)
    again = gr.prediction_log(le.as_vectors(rows), [0, 1], cells, 4, folder).collect()
    assert len(runs) == before and sorted(again) == sorted(log)
    right = [r for r in log if r.cell == "all -> scale -> logistic"]
    assert sum(r.pred == r.label for r in right) > 50
    assert all(r.pred is None for r in log if r.cell.startswith("lasso 0.40 -> pca3"))  # too few features are left for three components


def test_grid_spreads_rows_of_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(gr, "ROWS_PER_TASK", 10)
    rows = spark.range(60).coalesce(1).selectExpr("id name", "array(double(id % 2), double(id % 7)) features", "int(id % 2) label", "int(id div 2 % 2) fold")
    cells = [le.Cell(0.0, "scale", "logistic")]
    log = gr.prediction_log(le.as_vectors(rows), [0, 1], cells, 2, str(tmp_path), jobs=1)
    assert log.count() == 60 and log.filter("pred = label").count() == 60
    for table in ("rows", "prepared"):
        parts = [spark.read.parquet(str(p)).count() for p in (tmp_path / table).rglob("*.parquet")]
        assert max(parts) < 60 and sum(n > 0 for n in parts) > 1


# ---- classifiers ---------------------------------------------------------------------------------------------

def blobs(spark, n=160, width=3, labels=2, seed=6):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % labels
    x = rng.normal(size=(n, width)) + 1.2 * np.eye(max(width, labels))[y][:, :width]
    return x, y, spark.createDataFrame([(x[i].tolist(), int(y[i])) for i in range(n)], "x array<double>, label int").withColumn("x", le.array_to_vector("x"))


def test_logistic_regression_is_at_the_minimum(spark):
    x, y, df = blobs(spark)
    n = len(y)
    model = le.classifier("logistic", n, 2).fit(df)
    w, b = model.coefficients.toArray(), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    # mean loss plus |w|^2 / (2n): a unit penalty on the sum of losses; the intercept is free
    assert x.T @ (p - y) / n + w / n == pytest.approx(np.zeros(3), abs=1e-4) and (p - y).mean() == pytest.approx(0, abs=1e-4)


def test_linear_machine_is_near_the_minimum(spark):
    x, y, df = blobs(spark)
    n, sign = len(y), 2 * y - 1
    model = le.classifier("svm", n, 2, steps=200).fit(df)
    cost = lambda w, b: np.maximum(0, 1 - sign * (x @ w + b)).mean() + w @ w / (2 * n)
    best = cost(model.coefficients.toArray(), model.intercept)
    rng = np.random.default_rng(1)
    for _ in range(400):
        step = rng.normal(scale=rng.choice([0.01, 0.1, 0.5]), size=4)
        assert cost(model.coefficients.toArray() + step[:3], model.intercept + step[3]) > best - 2e-3


def test_more_labels_and_trees(spark):
    x, y, df = blobs(spark, 300, 4, 3)
    for kind in ("svm", "forest", "logistic"):
        model = le.classifier(kind, 300, 3).fit(df)
        got = [r.prediction for r in model.transform(df).collect()]
        assert np.mean(np.array(got) == y) > 0.6
    again = [r.prediction for r in le.classifier("forest", 300, 3).fit(df).transform(df).collect()]
    assert again == [r.prediction for r in le.classifier("forest", 300, 3).fit(df).transform(df).collect()]


def test_random_features_approach_the_kernel(spark):
    x, _, _ = blobs(spark, 40)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")
    z = np.array([r.z for r in rows.select("i", le.fourier_features(F.col("v"), 3, n_out=4096).alias("z")).orderBy("i").collect()])
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / 3)
    assert np.abs(z @ z.T - kernel).max() < 0.12
