"""Scaling and dimensionality reduction."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.sources.tables import local_table, materialise


def by_batch(change):
    """A vectorised function of rows of numbers (rows x columns in, rows x columns out) as a column function."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(change(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    return run


@dataclass
class Scaler:
    """Mean 0 and population standard deviation 1; constant columns keep their scale."""

    mean: np.ndarray
    std: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, col: str = "x") -> Scaler:
        vec = array_to_vector(F.col(col)).alias("v")
        stats = Summarizer.metrics("mean", "variance", "count")
        row = df.select(vec).select(stats.summary(F.col("v")).alias("s")).select("s.*").first()
        n = row["count"]
        var = row["variance"].toArray() * (n - 1) / max(n, 1)
        std = np.sqrt(np.maximum(var, 0.0))
        std[std < 1e-12] = 1.0
        return cls(row["mean"].toArray(), std)

    def transform(self, df: DataFrame, col: str = "x", output_col: str | None = None) -> DataFrame:
        mean, std = F.lit(self.mean.tolist()), F.lit(self.std.tolist())
        centred = F.zip_with(F.col(col), mean, lambda x, m: x - m)
        return df.withColumn(output_col or col, F.zip_with(centred, std, lambda x, s: x / s))


@dataclass
class PcaReducer:
    """Principal components of centred data; each axis has its largest loading positive."""

    mean: np.ndarray
    components: np.ndarray  # features x components
    variance: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, k: int | None = None, col: str = "x") -> PcaReducer:
        scaler = Scaler.fit(df, col)
        centre = Scaler(scaler.mean, np.ones_like(scaler.mean))
        d = len(scaler.mean)
        k = k or max(1, min(100, d // 2))
        vec = centre.transform(df, col).select(array_to_vector(col).alias("v"))
        model = PCA(k=k, inputCol="v", outputCol="pc").fit(vec)
        axes = model.pc.toArray()
        flip = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
        return cls(scaler.mean, axes * np.where(flip == 0, 1.0, flip), model.explainedVariance.toArray())

    def transform(self, df: DataFrame, col: str = "x", output_col: str | None = None) -> DataFrame:
        mean, axes = self.mean, self.components
        return df.withColumn(output_col or col, by_batch(lambda x: (x - mean) @ axes)(col))

    def save(self, spark, path: str) -> None:
        """One row per component."""
        k = len(self.variance)
        local_table(
            spark,
            {
                "component": list(range(k)), "axis": self.components.T.tolist(), "variance": self.variance.tolist(),
                "mean": [self.mean.tolist()] * k,
            },
        ).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> PcaReducer:
        rows = spark.read.parquet(path).orderBy("component").collect()
        return cls(
            np.array(rows[0]["mean"]), np.array([r["axis"] for r in rows]).T, np.array([r["variance"] for r in rows])
        )


def reduce_dimensions(train: DataFrame, test: DataFrame, method: str = "pca", k: int | None = None, col: str = "x"):
    """Fit on the training rows, apply to both; returns (train, test, reducer)."""
    if method == "pca":
        reducer = PcaReducer.fit(train, k, col)
        return reducer.transform(train, col), reducer.transform(test, col), reducer
    if method == "lda":
        d = len(train.select(col).first()[0])
        if train.filter(F.exists(col, lambda v: v < 0)).limit(1).count():
            raise ValueError("topic reduction needs non-negative features")
        to_vec = lambda df: df.withColumn("_v", array_to_vector(col))
        model = LDA(k=k or max(2, min(100, d // 2)), featuresCol="_v", topicDistributionCol="_t", seed=42).fit(to_vec(train))
        apply = lambda df: model.transform(to_vec(df)).withColumn(col, vector_to_array("_t")).drop("_v", "_t")
        return apply(train), apply(test), model
    raise ValueError(f"unknown reduction method {method!r}")


def scorer(metric: str = "recall", label: str = "y") -> MulticlassClassificationEvaluator:
    names = {"recall": "recallByLabel", "precision": "precisionByLabel", "f1": "fMeasureByLabel"}
    if metric == "accuracy":
        return MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    return MulticlassClassificationEvaluator(labelCol=label, metricName=names[metric], metricLabel=1.0)


def component_data(df: DataFrame, max_k: int, fold_col: str = "fold") -> DataFrame:
    """Scaled rows on their leading components; a smaller k only slices the stored vector."""
    scaled = Scaler.fit(df).transform(df)
    reduced = PcaReducer.fit(scaled, max_k).transform(scaled)
    return materialise(
        reduced.select(
            array_to_vector("x").alias("v"),
            F.col("y").cast("double").alias("y"),
            F.col(fold_col).cast("int").alias("fold"),
        ),
        "components",
        even=True,
    )


def sliced_score(data: DataFrame, k: int, metric: str = "recall", folds: int = 5, max_iter: int = 100) -> float:
    """Cross-validated score of logistic regression on the first k entries of ``v``."""
    sliced = VectorSlicer(inputCol="v", outputCol="features", indices=list(range(k))).transform(data)
    lr = LogisticRegression(labelCol="y", regParam=1.0 / 1000, maxIter=max_iter)
    cv = CrossValidator(
        estimator=lr, estimatorParamMaps=ParamGridBuilder().build(), evaluator=scorer(metric), numFolds=folds,
        foldCol="fold", parallelism=folds,
    )
    return float(cv.fit(sliced).avgMetrics[0])


def component_grid(df: DataFrame, ks: list[int], metric: str = "recall", fold_col: str = "fold") -> DataFrame:
    """All candidates, best first."""
    data = component_data(df, max(ks), fold_col)
    scores = [(k, sliced_score(data, k, metric)) for k in ks]
    table = local_table(df.sparkSession, {"k": [s[0] for s in scores], "score": [s[1] for s in scores]})
    return table.orderBy(F.desc("score"), "k")


def stop_at(scores: list[tuple[int, float]], tol: float) -> int | None:
    """First k whose score changed by less than ``tol`` from the previous one."""
    for (_, before), (k, now) in zip(scores, scores[1:], strict=False):
        if abs(now - before) < tol:
            return k
    return None


@dataclass
class ComponentSearch:
    scores: DataFrame
    best_k: int
    recommended_k: int


def find_components(
    df: DataFrame, max_k: int | None = None, tol: float = 0.001, early_stopping: bool = True, metric: str = "recall",
    fold_col: str = "fold",
) -> ComponentSearch:
    """Score k = 1, 2, ... until the mean score settles; the best k stands in if it never does."""
    d = len(df.select("x").first()[0])
    max_k = max_k or d
    scores: list[tuple[int, float]] = []
    data = component_data(df, max_k, fold_col)
    stopped = None
    for k in range(1, max_k + 1):
        scores.append((k, sliced_score(data, k, metric)))
        stopped = stop_at(scores, tol)
        if early_stopping and stopped:
            break
    best = max(scores, key=lambda s: (s[1], -s[0]))[0]
    table = local_table(df.sparkSession, {"k": [s[0] for s in scores], "score": [s[1] for s in scores]})
    return ComponentSearch(table, best, stopped or best)
