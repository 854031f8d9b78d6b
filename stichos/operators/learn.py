"""Feature selection, components and classifiers (P-1 ... P-10, P-13, P-18 ... P-21)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from stichos.operators import lasso

THRESHOLDS = (0.0, 0.15, 0.25, 0.4)
COMPONENTS = (2, 3, 4)
NEIGHBOURS = (2, 3, 4, 5)
SEED = 5


def as_vectors(rows: DataFrame, features: str = "features") -> DataFrame:
    return rows.withColumn(features, array_to_vector(F.col(features).cast("array<double>")))


# ---- selection and components -------------------------------------------------------------------

def lasso_coefficients(train: DataFrame, label: str = "label", features: str = "features", folds: int = lasso.INNER) -> np.ndarray:
    """P-1: coefficients at the penalty of a path from the data that cross-validation picks (one per feature); one scan."""
    return lasso.cross_validated(lasso.total_moments(lasso.fold_moments(train, label, features, n_inner=folds)))[1]


def select_features(coefficients: np.ndarray, threshold: float) -> list[int]:
    """Columns to keep; a threshold of 0 keeps all."""
    if threshold <= 0:
        return list(range(len(coefficients)))
    return [int(i) for i in np.flatnonzero(np.abs(coefficients) >= threshold)]


def selected_features(train: DataFrame, names: DataFrame, threshold: float, **kw) -> DataFrame:
    """P-1 report: the names of the kept features with their coefficients."""
    coef = lasso_coefficients(train, **kw)
    keep = [(i, float(coef[i])) for i in select_features(coef, threshold)]
    kept = train.sparkSession.createDataFrame(keep, "feature_idx int, coefficient double")
    return kept.join(names, "feature_idx")


def centred_pca(k: int, features: str = "features", out: str = "components") -> Pipeline:
    """P-2: the projection of centred rows (the transformer alone does not centre)."""
    return Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred"),
                            PCA(k=k, inputCol="_centred", outputCol=out)])


def project(train: DataFrame, test: DataFrame | None, k: int, keep: list[str]) -> DataFrame:
    """P-3: coordinates of training and test rows in the training components."""
    model = centred_pca(k).fit(train)
    rows = train.withColumn("is_test", F.lit(False))
    if test is not None:
        rows = rows.unionByName(test.withColumn("is_test", F.lit(True)))
    xs = vector_to_array("components")
    return model.transform(rows).select(*keep, "is_test", *[xs[i].alias(f"pc{i + 1}") for i in range(k)])


def loadings(train: DataFrame, k: int) -> DataFrame:
    """P-4: (component, feature_idx, loading, rank by size), non-zero only.

    The matrix is features x k, so its size is set by the feature layout, not by rows.
    """
    pc = centred_pca(k).fit(train).stages[1].pc.toArray()
    rows = [(c, f, float(pc[f, c])) for c in range(k) for f in range(pc.shape[0]) if pc[f, c] != 0.0]
    df = train.sparkSession.createDataFrame(rows, "component int, feature_idx int, loading double")
    order = Window.partitionBy("component").orderBy(F.desc(F.abs("loading")), "feature_idx")
    return df.withColumn("rank", F.row_number().over(order))


def contributions(long_: DataFrame, load: DataFrame, keys: list[str]) -> DataFrame:
    """P-5: value x loading per component, feature and row, and the running total in
    loading order. A window holds the features of one row, never more."""
    each = long_.join(load, "feature_idx").withColumn("part", F.col("value") * F.col("loading"))
    order = Window.partitionBy("component", *keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return each.withColumn("running", F.sum("part").over(order))


def scaler(features: str = "features", out: str = "scaled") -> StandardScaler:
    """P-6 (sample standard deviation, n - 1)."""
    return StandardScaler(withMean=True, withStd=True, inputCol=features, outputCol=out)


def fourier_features(features, width: int, n_out: int = 256, seed: int = SEED) -> Column:
    """P-9: random Fourier features of the RBF kernel with gamma = 1 / width.

    A fixed matrix of width x n_out drawn from the seed; Arrow batches, one product each.
    """
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2.0 / width), size=(width, n_out))
    b = rng.uniform(0, 2 * np.pi, size=n_out)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def mapped(v: pd.Series) -> pd.Series:
        if v.empty:
            return v
        return pd.Series(list(np.sqrt(2.0 / n_out) * np.cos(np.stack(v.to_numpy()) @ w + b)))

    return mapped(features)


# ---- the grid (P-13) ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Cell:
    threshold: float
    prep: str          # "scale" or "pca2" ...
    classifier: str    # "logistic", "svm", "rbf", "forest", "knn3", "knn3w"

    @property
    def name(self) -> str:
        select = f"lasso {self.threshold:.2f}" if self.threshold > 0 else "all"
        return f"{select} -> {self.prep} -> {self.classifier}"


def grid(thresholds=THRESHOLDS) -> list[Cell]:
    """P-13; the RBF kernel is left out where lasso meets plain scaling."""
    preps = ["scale", *[f"pca{k}" for k in COMPONENTS]]
    methods = ["logistic", "svm", "rbf", "forest", *[f"knn{k}{w}" for k in NEIGHBOURS for w in ("w", "")]]
    return [Cell(t, p, c) for t in thresholds for p in preps for c in methods
            if not (t > 0 and p == "scale" and c == "rbf")]


def prepare(rows: DataFrame, train: Column, cell: Cell, coefficients: np.ndarray | None, width: int) -> tuple[DataFrame, int] | None:
    """Select and scale / project all rows with what the training rows say; nothing if too few features are left for it."""
    features = "features"
    if coefficients is not None:
        kept = select_features(coefficients, cell.threshold)
        if not kept:
            return None
        rows = VectorSlicer(inputCol="features", outputCol="_kept", indices=kept).transform(rows)
        features, width = "_kept", len(kept)
    if cell.prep == "scale":
        stage: object = scaler(features, "x")
    else:
        k = int(cell.prep[3:])
        if k > width:
            return None
        stage, width = centred_pca(k, features, "x"), k
    out = stage.fit(rows.filter(train)).transform(rows)
    return out.drop("_kept", "_centred"), width


def classifier(kind: str, n_rows: int, n_labels: int, trees: int = 10, depth: int = 10, steps: int = 100):
    """P-7, P-8, P-10 (and the linear part of P-9). The penalty of the logistic model is
    1/n, of the machines likewise, which is a unit penalty on the sum of losses, on the columns as given. Trees of unlimited
    depth cannot be had here: `depth` bounds them (30 at most); `steps` bounds the iterations of the machines."""
    if kind == "logistic":
        return LogisticRegression(featuresCol="x", labelCol="label", regParam=1.0 / max(n_rows, 1), standardization=False)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED)
    svm = LinearSVC(featuresCol="x", labelCol="label", regParam=1.0 / max(n_rows, 1), maxIter=steps, standardization=False)
    return svm if n_labels <= 2 else OneVsRest(classifier=svm, featuresCol="x", labelCol="label")


def training(rows: DataFrame, fold_value) -> Column:
    """Rows that a fold is fitted on: not its own, and not those a selector only tests."""
    train = F.coalesce(F.col("fold") != fold_value, F.lit(True))
    return train & ~F.col("is_test") if "is_test" in rows.columns else train


# ---- reports (P-19 ... P-21) ----------------------------------------------------------------------

def accuracy(log: DataFrame) -> DataFrame:
    """P-19: accuracy per cell and fold, then the mean of the folds per cell."""
    per = log.groupBy("cell", "fold").agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                                          F.count("*").alias("n_rows"))
    return per


def mean_accuracy(log: DataFrame) -> DataFrame:
    """P-19: mean over folds per cell, and over all cells."""
    cells = accuracy(log).groupBy("cell").agg(F.avg("accuracy").alias("mean_accuracy"))
    return cells.unionByName(cells.agg(F.avg("mean_accuracy").alias("mean_accuracy")).select(F.lit("Overall").alias("cell"), "mean_accuracy"))


def prep_averages(log: DataFrame) -> DataFrame:
    """P-14: per selection and preparation the mean of its cells' mean accuracies (cells without a fit are left out), and the total."""
    cells = accuracy(log).groupBy("cell").agg(F.avg("accuracy").alias("a"))
    parts = F.split("cell", " -> ")
    each = cells.groupBy(parts[0].alias("selection"), parts[1].alias("prep")).agg(F.avg("a").alias("mean_accuracy"), F.count("a").alias("n_cells"))
    total = cells.agg(F.lit("Total").alias("selection"), F.lit("").alias("prep"), F.avg("a").alias("mean_accuracy"), F.count("a").alias("n_cells"))
    return each.unionByName(total)


def mismatches(log: DataFrame) -> DataFrame:
    return log.filter("pred <> label")


def failures_by_row(log: DataFrame, key: str = "name") -> DataFrame:
    """P-20: how many cells fail on a row and which; a list holds at most the cells."""
    wrong = F.col("pred") != F.col("label")
    return log.groupBy(key).agg(
        F.count("*").alias("n_cells"), F.count_if(wrong).alias("n_failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(wrong, F.col("cell")))), ", ").alias("failed_on")).withColumn(
        "failed_percent", 100.0 * F.col("n_failed") / F.col("n_cells"))


def side_by_side(reports: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """P-21: failure shares of the schemes next to each other."""
    out = None
    for scheme, df in reports.items():
        part = df.select(key, F.col("failed_percent").alias(scheme))
        out = part if out is None else out.join(part, key, "full")
    return out


def aligned_by_book(table: DataFrame, texts: list[str], values: list[str], text: str = "text_name", book: str = "book") -> DataFrame:
    """P-21: two texts next to each other, book by book."""
    return (table.filter(F.col(text).isin(*texts)).groupBy(book).pivot(text, texts)
            .agg(*[F.max(v).alias(v) for v in values]))
