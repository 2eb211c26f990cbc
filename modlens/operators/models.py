"""Classifiers as Spark ML pipelines.

Every fitted model is a ``PipelineModel``; ``score`` turns it into ``(id, label, p)`` rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
)
from pyspark.ml.feature import StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.operators.stages import BoostedStumps, FourierFeatures
from modlens.operators.trees import BoostParams, RandomParams, boost, random_trees
from modlens.sources.tables import local_table, materialise, release

SEED = 42
MAX_DEPTH = 30  # the deepest tree Spark grows
STORE_EVERY = 8  # boosting rounds between two writes of the weights


def assemble(df: DataFrame, features: Sequence[str], label: str, id_col: str = "doc_id", extra: Sequence[str] = ()) -> DataFrame:
    """``(id, features, label)`` with one vector column."""
    vec = VectorAssembler(inputCols=list(features), outputCol="features")
    return vec.transform(df).select(id_col, "features", F.col(label).cast("double").alias("label"), *extra)


def class_weights(df: DataFrame, label: str = "label") -> dict[float, float]:
    """Balanced weights ``n / (classes * n_class)``."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def balanced_weight(df: DataFrame, label: str = "label", output_col: str = "weight") -> DataFrame:
    weights = class_weights(df, label)
    expr = F.lit(1.0)
    for c, w in weights.items():
        expr = F.when(F.col(label) == c, w).otherwise(expr)
    return df.withColumn(output_col, expr)


def probability(model, scored: DataFrame) -> Column:
    return F.col("p") if "p" in scored.columns else vector_to_array("probability")[1]


def score(model: PipelineModel, df: DataFrame, id_col: str = "doc_id", name: str | None = None) -> DataFrame:
    """``(id, label, p)``, with the model's name in front if given."""
    scored = model.transform(df)
    keep = [id_col, *([F.col("label").cast("int").alias("label")] if "label" in df.columns else [])]
    out = scored.select(*keep, probability(model, scored).alias("p"))
    return out.select(F.lit(name).alias("model"), *out.columns) if name else out


def logistic(df: DataFrame, c: float = 1.0, max_iter: int = 5000, balanced: bool = False, standardise: bool = True) -> PipelineModel:
    """L2 logistic regression with inverse strength ``c``."""
    n = df.count()
    stages = []
    col = "features"
    if standardise:
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True))
        col = "scaled"
    params = dict(featuresCol=col, labelCol="label", regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=max_iter, standardization=False)
    if balanced:
        params["weightCol"] = "weight"
    return Pipeline(stages=[*stages, LogisticRegression(**params)]).fit(balanced_weight(df) if balanced else df)


def linear_svm(df: DataFrame, c: float = 1.0, balanced: bool = True, max_iter: int = 100,
               before: Sequence = ()) -> PipelineModel:
    """Linear support vector machine with Platt's sigmoid on the margin."""
    n = df.count()
    params = dict(featuresCol="scaled", labelCol="label", regParam=1.0 / (c * n), maxIter=max_iter, rawPredictionCol="svm_raw", predictionCol="svm_class", standardization=False)
    if balanced:
        params["weightCol"] = "weight"
    stages = [
        StandardScaler(inputCol="features", outputCol="scaled_input" if before else "scaled", withMean=True, withStd=True),
        *before,
        LinearSVC(**params),
        VectorSlicer(inputCol="svm_raw", outputCol="margin", indices=[1]),
        LogisticRegression(featuresCol="margin", labelCol="label", maxIter=100),
    ]
    return Pipeline(stages=stages).fit(balanced_weight(df) if balanced else df)


def kernel_svm(df: DataFrame, c: float = 1.0, gamma: float | str = "scale", kernel: str = "rbf", balanced: bool = False,
               dimension: int = 128, max_iter: int = 100) -> PipelineModel:
    """Linear SVM, or a Gaussian-kernel SVM through random Fourier features."""
    if kernel == "linear":
        return linear_svm(df, c, balanced, max_iter)
    if kernel != "rbf":
        raise ValueError(f"unknown kernel {kernel!r}")
    # On standardised features "scale" and "auto" are both one over the feature count.
    width = 1.0 / df.first()["features"].size if isinstance(gamma, str) else gamma
    fourier = FourierFeatures(inputCol="scaled_input", outputCol="scaled", gamma=width, dimension=dimension, seed=SEED)
    return linear_svm(df, c, balanced, max_iter, before=[fourier])


def _subset(value) -> str:
    """Features per split: a named rule, a share, or all of them."""
    return "all" if value is None else str(value)


def _depth(value) -> int:
    return MAX_DEPTH if value is None else min(int(value), MAX_DEPTH)


def _class_weight(df: DataFrame) -> Column:
    """Balanced weights, the largest 1."""
    weights = class_weights(df)
    weight = F.lit(1.0)
    for c, w in weights.items():
        weight = F.when(F.col("label") == c, w / max(weights.values())).otherwise(weight)
    return weight


def random_forest(df: DataFrame, n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1,
                  max_features="sqrt", bootstrap: bool = True, class_weight: str | None = None, max_bins: int = 32) -> PipelineModel:
    """Trees with the best cut of a random subset of features at each node, on bootstrap samples."""
    params = RandomParams(
        n_estimators, _depth(max_depth), min_samples_leaf, max_features, bootstrap, max_bins, SEED, best=True, round_up=True
    )
    return random_trees(df, params, _class_weight(df) if class_weight else None)


def extra_trees(df: DataFrame, n_estimators: int = 100, max_depth: int | None = None, min_samples_leaf: int = 1,
                max_features="sqrt", bootstrap: bool = False, class_weight: str | None = None) -> PipelineModel:
    """Trees with random split points, on all rows unless ``bootstrap``."""
    weight = _class_weight(df) if class_weight else None
    return random_trees(df, RandomParams(n_estimators, _depth(max_depth), min_samples_leaf, max_features, bootstrap, seed=SEED), weight)


def gradient_boosting(df: DataFrame, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3,
                      min_samples_leaf: int = 1, subsample: float = 1.0, max_features=None, min_info_gain: float = 0.0) -> PipelineModel:
    gbt = GBTClassifier(
        maxIter=n_estimators, stepSize=learning_rate, maxDepth=_depth(max_depth), minInstancesPerNode=min_samples_leaf,
        subsamplingRate=subsample, featureSubsetStrategy=_subset(max_features), minInfoGain=min_info_gain, seed=SEED,
        labelCol="label",
    )
    return Pipeline(stages=[gbt]).fit(df)


def xgb_style(df: DataFrame, n_estimators=100, max_depth=6, learning_rate=0.3, subsample=1.0, colsample_bytree=1.0,
              gamma=0.0, min_child_weight=1, reg_lambda=1.0) -> PipelineModel:
    """Boosting by second-order gains with a penalty on leaf values, level by level; splits under ``gamma`` are pruned."""
    return boost(df, BoostParams(
        rounds=n_estimators, learning_rate=learning_rate, max_depth=_depth(max_depth), subsample=subsample, colsample=colsample_bytree,
        gamma=gamma, min_child_weight=min_child_weight, reg_lambda=reg_lambda, seed=SEED,
    ))


def lgbm_style(df: DataFrame, n_estimators=100, max_depth=6, learning_rate=0.1, subsample=1.0, colsample_bytree=1.0,
               num_leaves=31, min_child_samples=20, reg_lambda=0.0) -> PipelineModel:
    """Boosting that always splits the leaf with the largest gain, up to ``num_leaves``; starts at the log odds."""
    return boost(df, BoostParams(
        rounds=n_estimators, learning_rate=learning_rate, max_depth=_depth(max_depth), max_leaves=num_leaves, subsample=subsample,
        colsample=colsample_bytree, min_child_rows=min_child_samples, min_child_weight=1e-3, reg_lambda=reg_lambda,
        average_start=True, seed=SEED,
    ))


def weighted_errors(df: DataFrame, vote: Column, weight: Column) -> tuple[float, float]:
    """(weighted error, total weight) of a stump, in one aggregation."""
    wrong = F.when(vote != F.col("label"), weight).otherwise(0.0)
    row = df.agg(F.sum(wrong).alias("e"), F.sum(weight).alias("w")).first()
    return row["e"], row["w"]


def adaboost(df: DataFrame, n_estimators: int = 50, learning_rate: float = 1.0) -> PipelineModel:
    """Discrete AdaBoost (SAMME) over stumps.

    Rows are kept with their weight in a shared table, written anew every ``STORE_EVERY`` rounds; between
    two writes the weight is the stored one times the votes since, so a round's work stays the same.
    """
    spark = df.sparkSession
    values = vector_to_array("features")
    rules: list[list[float]] = []
    stored = materialise(df.select("features", "label", F.lit(1.0).alias("w0")), "boosting")
    weight: Column = F.col("w0")
    for done in range(n_estimators):
        if done and done % STORE_EVERY == 0:
            previous, stored = stored, materialise(stored.select("features", "label", weight.alias("w0")), "boosting")
            release(spark, previous)
            weight = F.col("w0")
        data = stored.select("features", "label", weight.alias("w"))
        tree = DecisionTreeClassifier(maxDepth=1, weightCol="w", labelCol="label", seed=SEED).fit(data)
        root = tree._call_java("rootNode")
        if tree.depth == 0:
            constant = float(root.prediction())
            rule = [0, math.inf, constant, constant]
        else:
            split = root.split()
            rule = [
                split.featureIndex(), split.threshold(),
                float(root.leftChild().prediction()), float(root.rightChild().prediction()),
            ]
        if math.isinf(rule[1]):
            rule[1] = 1e308
        vote = F.when(F.get(values, F.lit(int(rule[0]))) <= rule[1], rule[2]).otherwise(rule[3])
        error, total = weighted_errors(stored, vote, weight)
        err = error / total
        if err <= 1e-12:
            rules.append([*rule, 1.0])
            break
        if err >= 0.5:
            if not rules:
                rules.append([*rule, 1.0])
            break
        alpha = learning_rate * math.log((1 - err) / err)
        rules.append([*rule, alpha])
        weight = weight * F.when(vote != F.col("label"), math.exp(alpha)).otherwise(1.0)
    release(spark, stored)
    return PipelineModel([BoostedStumps(inputCol="features", outputCol="p", rules=json.dumps(rules))])


def importances(model: PipelineModel, features: Sequence[str], name: str) -> DataFrame | None:
    """``(model, feature, importance)`` of a tree model or a stump vote."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif isinstance(last, BoostedStumps):
        values = np.zeros(len(features))
        for f, *_, w in json.loads(last.getOrDefault(last.rules)):
            values[int(f)] += w
        values = values / (values.sum() or 1.0)
    else:
        return None
    return local_table(
        SparkSession.getActiveSession(),
        {"model": [name] * len(features), "feature": list(features), "importance": values.tolist()},
    )


TRAINERS: dict[str, Callable[..., PipelineModel]] = {
    "random_forest": random_forest,
    "gradient_boosting": gradient_boosting,
    "svm": kernel_svm,
    "xgboost": xgb_style,
    "lightgbm": lgbm_style,
    "extra_trees": extra_trees,
    "adaboost": adaboost,
}


def multilabel(df: DataFrame, features: Sequence[str], labels: Sequence[str], fit: Callable[[DataFrame], PipelineModel] = logistic,
               id_col: str = "doc_id") -> tuple[Mapping[str, PipelineModel], Callable[[DataFrame], DataFrame]]:
    """One model per label on the same feature vectors, and a scorer to long ``(id, label, p)`` rows."""
    vec = VectorAssembler(inputCols=list(features), outputCol="features")
    models = {}
    for name in labels:
        models[name] = fit(vec.transform(df).select(id_col, "features", F.col(name).cast("double").alias("label")))

    def scored(new: DataFrame) -> DataFrame:
        rows = vec.transform(new).select(id_col, "features", *labels)
        parts = [
            score(m, rows.select(id_col, "features", F.col(name).cast("double").alias("label")), id_col, name)
            for name, m in models.items()
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return models, scored
