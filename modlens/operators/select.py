"""Feature statistics and selection over wide numeric tables.

A statistic is one aggregation of the wide table to a few rows per class; only that small result is
turned to the long form, so the shuffle never carries rows times features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.operators.ranking import rank_slices
from modlens.operators.split import stratified_sample
from modlens.sources.tables import local_table, settle


def _long(df: DataFrame, keep: Sequence[str], features: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Wide aggregates ``feature|part`` to ``(keep, feature, parts...)``."""
    rows = [
        F.struct(F.lit(f).alias("feature"), *[F.col(f"`{f}|{p}`").cast("double").alias(p) for p in parts])
        for f in features
    ]
    return df.select(*keep, F.inline(F.array(*rows)))


def class_sums(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(label, n, feature, s, ss)``: sums and sums of squares by class."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.sum(x).alias(f"{f}|s"), F.sum(x * x).alias(f"{f}|ss")]
    wide = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *aggs)
    return _long(wide, ["label", "n"], features, ["s", "ss"])


def chi2_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Chi-squared of class sums of non-negative features against the class shares."""
    sums = class_sums(df, features, label)
    w = Window.partitionBy("feature")
    expected = F.sum("s").over(w) * F.col("n") / F.sum("n").over(w)
    return (
        sums.withColumn("e", expected)
        .groupBy("feature")
        .agg(F.sum(F.try_divide((F.col("s") - F.col("e")) * (F.col("s") - F.col("e")), F.col("e"))).alias("score"))
    )


def anova_f_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """One-way ANOVA F of each feature between the classes.

    Squares are taken around the overall mean, known from a first small pass, so that features with a
    large offset lose no digits.
    """
    means = df.agg(*[F.avg(f).alias(f) for f in features]).first()
    centred = df.select(label, *[(F.col(f) - F.lit(float(means[f] or 0.0))).alias(f) for f in features])
    g = class_sums(centred, features, label).groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("k"),
        F.sum("s").alias("s"),
        F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between_raw"),
    )
    between = F.col("between_raw") - F.col("s") * F.col("s") / F.col("n")
    within = F.col("ss") - F.col("between_raw")
    return g.select(
        "feature",
        F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k"))).alias("score"),
    )


def mutual_info_scores(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of the binned feature and the label, in nats.

    Bin edges are approximate quantiles (relative rank error 1/10000, exact on small data), so no
    feature is sorted as a whole.
    """
    probs = [i / bins for i in range(1, bins)]
    edges = df.agg(
        *[F.percentile_approx(F.col(f).cast("double"), probs, 10_000).alias(f) for f in features]
    ).first()

    def bin_of(feature: str) -> Column:
        limits = F.array(*[F.lit(float(e)) for e in edges[feature]])
        return F.size(F.filter(limits, lambda e: e < F.col(feature)))

    binned = [F.struct(F.lit(f).alias("feature"), bin_of(f).alias("bin")) for f in features]
    joint = (
        df.select(F.col(label).alias("label"), F.inline(F.array(*binned)))
        .groupBy("feature", "bin", "label")
        .agg(F.count("*").alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy("feature"))
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    by_label = F.sum("n").over(Window.partitionBy("feature", "label"))
    term = F.col("n") / total * F.log(F.col("n") * total / (by_bin * by_label))
    return joint.withColumn("term", term).groupBy("feature").agg(F.sum("term").alias("score"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The k best features; an undefined score ranks last."""
    return scores.orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def correlated_pairs(df: DataFrame, features: Sequence[str], threshold: float = 0.4) -> DataFrame:
    """Feature pairs with ``|r| >= threshold``, from one pass that builds the Gram matrix."""
    vec = VectorAssembler(inputCols=list(features), outputCol="v").transform(df.select(*features)).select("v")
    r = Correlation.corr(vec, "v").first()[0].toArray()
    i, j = np.where(np.triu(np.nan_to_num(np.abs(r)) >= threshold, 1))
    pairs = [sorted((features[a], features[b])) for a, b in zip(i, j, strict=True)]
    schema = pa.schema([("feature_a", pa.string()), ("feature_b", pa.string()), ("r", pa.float64())])
    return local_table(
        df.sparkSession,
        {"feature_a": [p[0] for p in pairs], "feature_b": [p[1] for p in pairs], "r": r[i, j].tolist()},
        schema,
    )


def prune_correlated(df: DataFrame, features: Sequence[str], threshold: float = 0.4) -> list[str]:
    """Features left when the later one of each correlated pair is dropped."""
    pairs = correlated_pairs(df, features, threshold).collect()
    order = {f: i for i, f in enumerate(features)}
    dropped: set[str] = set()
    for a, b in sorted((sorted((r["feature_a"], r["feature_b"]), key=order.get) for r in pairs), key=lambda p: [order[x] for x in p]):
        if a not in dropped:
            dropped.add(b)
    return [f for f in features if f not in dropped]


def k2_from_moments(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson statistic from size, population skewness and excess kurtosis."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / ((n - 2) * 6))
    beta = (n * n + n * 27 - 70) * 3 * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt((beta - 1) * 2) - 1
    z1 = F.asinh(y / F.sqrt(F.lit(2.0) / (w2 - 1))) / F.sqrt(F.log(w2) / 2)
    mean = (n - 1) * 3 / (n + 1)
    var = n * 24 * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (g2 + 3 - mean) / F.sqrt(var)
    b = (n * n - n * 5 + 2) * 6 / ((n + 7) * (n + 9)) * F.sqrt((n + 3) * (n + 5) * 6 / (n * (n - 2) * (n - 3)))
    a = F.lit(8.0) / b * (F.lit(2.0) / b + F.sqrt(F.lit(4.0) / (b * b) + 1)) + 6
    tail = (F.lit(1.0) - F.lit(2.0) / a) / (x * F.sqrt(F.lit(2.0) / (a - 4)) + 1)
    z2 = (F.lit(1.0) - F.lit(2.0) / (a * 9) - F.signum(tail) * F.cbrt(F.abs(tail))) / F.sqrt(F.lit(2.0) / (a * 9))
    return z1 * z1 + z2 * z2


def normality(long: DataFrame, alpha: float = 0.05) -> DataFrame:
    """K-squared test of ``(feature, value)`` rows: statistic, p value and verdict."""
    moments = long.groupBy("feature").agg(
        F.count("value").cast("double").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    )
    tested = moments.withColumn("k2", k2_from_moments(F.col("n"), F.col("g1"), F.col("g2"))).withColumn(
        "p", F.exp(-F.col("k2") / 2)
    )
    verdict = F.when(F.col("p") > alpha, "normally distributed").otherwise("NOT normally distributed")
    return tested.select("feature", "k2", "p", verdict.alias("verdict"))


def class_densities(df: DataFrame, features: Sequence[str], label: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of each feature within each class on a regular grid.

    Equal values are merged first.  Each class has its own grid and its own normalisation; the
    bandwidth is Scott's ``sd * n^(-1/5)``.
    """
    long = df.select(
        F.col(label).alias("label"),
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])),
    )
    values = long.groupBy("feature", "label", "x").agg(F.count("*").alias("w"))
    shape = settle(
        long.groupBy("feature", "label").agg(
            F.count("x").alias("n"), F.stddev_samp("x").alias("sd"), F.min("x").alias("low"), F.max("x").alias("high")
        )
    )
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    start, stop = F.col("low") - F.col("bw") * cut, F.col("high") + F.col("bw") * cut
    at = start + (stop - start) * F.col("i") / float(grid - 1)
    z = (F.col("at") - F.col("x")) / F.col("bw")
    points = (
        values.join(shape.withColumn("bw", bw).filter("bw > 0"), ["feature", "label"])
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .withColumn("at", at)
    )
    kernel = F.exp(z * z * -0.5) * F.col("w") / (F.col("n") * F.col("bw") * float(np.sqrt(2 * np.pi)))
    return points.groupBy("feature", "label", "i").agg(F.min("at").alias("at"), F.sum(kernel).alias("density"))


SELECTORS = {"chi2": chi2_scores, "f_classif": anova_f_scores, "mutual_info": mutual_info_scores}


@dataclass
class Selection:
    """Support of a selection and how to apply it to other data."""

    features: list[str]
    kept: list[str]

    def mask(self, spark) -> DataFrame:
        kept = set(self.kept)
        return local_table(
            spark,
            {"idx": list(range(len(self.features))), "feature": self.features, "kept": [f in kept for f in self.features]},
        )

    def apply(self, df: DataFrame) -> DataFrame:
        dropped = set(self.features) - set(self.kept)
        return df.select([c for c in df.columns if c not in dropped])

    def apply_vector(self, df: DataFrame, vector_col: str, output_col: str = "selected") -> DataFrame:
        at = {f: i for i, f in enumerate(self.features)}
        indices = [at[f] for f in self.kept]
        return VectorSlicer(inputCol=vector_col, outputCol=output_col, indices=indices).transform(df)


def select_features(df: DataFrame, features: Sequence[str], label: str, method: str = "chi2", k: int | None = None) -> Selection:
    """Keep the k best features by a score, or the non-zero ones of an L1 model."""
    features = list(features)
    if method == "model_based":
        return l1_selection(df, features, label)
    if method not in SELECTORS:
        raise ValueError(f"unknown selection method {method!r}; known: {sorted([*SELECTORS, 'model_based'])}")
    best = top_features(SELECTORS[method](df, features, label), min(k or 1000, len(features)))
    kept = {r["feature"] for r in best.collect()}
    return Selection(features, [f for f in features if f in kept])


def l1_selection(df: DataFrame, features: Sequence[str], label: str, c: float = 1.0, floor: float = 1e-5,
                 max_iter: int = 200) -> Selection:
    data = VectorAssembler(inputCols=list(features), outputCol="v").transform(df).select("v", F.col(label).alias("y"))
    n = data.count()
    model = LogisticRegression(
        featuresCol="v", labelCol="y", elasticNetParam=1.0, regParam=1.0 / (c * n), standardization=False, maxIter=max_iter
    ).fit(data)
    w = np.abs(model.coefficients.toArray())
    return Selection(list(features), [f for f, x in zip(features, w, strict=True) if x >= floor])


# Elastic net --------------------------------------------------------------------------------------

ALPHAS = [0.01, 0.1, 1.0, 10.0, 100.0]
L1_RATIOS = [0.1, 0.5, 0.7, 1.0]


def fold_grams(df: DataFrame, features: Sequence[str], target: str, fold_col: str) -> dict[int, np.ndarray]:
    """Cross-product matrix of ``[1, features, target]`` per fold, from one pass over the data.

    Tasks send one d-by-d partial per fold; the size depends on the features, not on the rows.
    """
    names = [*features, target]
    d = len(names) + 1

    def partial(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, rows in batch.groupby("_fold"):
                x = np.column_stack([np.ones(len(rows)), rows[names].to_numpy(dtype=float)])
                sums[fold] = sums.get(fold, np.zeros((d, d))) + x.T @ x
        for fold, gram in sums.items():
            yield pd.DataFrame({"fold": [int(fold)], "gram": [gram.ravel()]})

    data = df.select(F.col(fold_col).alias("_fold"), *[F.col(c).cast("double").alias(c) for c in names])
    partials = data.mapInPandas(partial, "fold int, gram array<double>")
    cells = partials.select("fold", F.posexplode("gram").alias("i", "v")).groupBy("fold", "i").agg(F.sum("v").alias("v"))
    merged = cells.groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("g"))
    return {
        r["fold"]: np.array([c["v"] for c in r["g"]]).reshape(d, d) for r in merged.collect()
    }


def elastic_net(gram: np.ndarray, alpha: float, l1_ratio: float, max_iter: int = 100, tol: float = 1e-4):
    """Coefficients and intercept minimising ``|y-Xb|^2/2n + alpha*(rho|b|_1 + (1-rho)/2 |b|^2)``,
    by cyclic coordinate descent on the sufficient statistics."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] / n - np.outer(mean, mean)
    sxx, sxy = cov[:-1, :-1], cov[:-1, -1]
    beta = np.zeros(len(sxy))
    for _ in range(max_iter):
        largest = 0.0
        for j in range(len(beta)):
            if sxx[j, j] <= 1e-15:
                continue
            rho = sxy[j] - sxx[j] @ beta + sxx[j, j] * beta[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / (sxx[j, j] + alpha * (1 - l1_ratio))
            largest, beta[j] = max(largest, abs(new - beta[j])), new
        if largest <= tol * max(np.abs(beta).max(), 1e-12):
            break
    return beta, mean[-1] - mean[:-1] @ beta


def gram_mse(gram: np.ndarray, beta: np.ndarray, intercept: float) -> float:
    """Mean squared error of a linear model on the rows behind a cross-product matrix."""
    w = np.concatenate([[intercept], beta, [-1.0]])
    return float(w @ gram @ w / gram[0, 0])


@dataclass
class ElasticNetResult:
    coefficients: DataFrame  # (feature, coefficient)
    cv: DataFrame  # (alpha, l1_ratio, mse)
    alpha: float
    l1_ratio: float
    holdout_mse: float
    selection: Selection


def elastic_net_selection(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    threshold: float = 0.01,
    folds: int = 5,
    id_col: str = "doc_id",
    seed: int = 42,
    standardize: bool = False,
    sample_fraction: float | None = None,
) -> ElasticNetResult:
    """Grid search of the elastic net by cross-validation, then culling of small coefficients.

    A fifth of the rows is held out.  All fits work on per-fold cross products, so the grid costs one
    pass over the data however many candidates there are.
    """
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column")
    if sample_fraction is not None and not 0 < sample_fraction <= 1:
        raise ValueError("sample_fraction must be in (0, 1]")
    features = list(features)
    if sample_fraction is not None and sample_fraction < 1:
        df = stratified_sample(df, [target], sample_fraction, seed, id_col)
    # Slice 0 is the held-out fifth, slices 1 to folds are the folds of the rest.
    wanted = {"0": lambda n: F.ceil(n * 0.2)}
    for i in range(1, folds):
        wanted[str(i)] = lambda n, i=i: F.ceil(n * 0.2) + F.ceil((n - F.ceil(n * 0.2)) * i / folds)
    grams = fold_grams(rank_slices(df, id_col, seed, wanted, (), "_slice"), features, target, "_slice")
    holdout = grams.pop(0)
    train = sum(grams.values())
    scale = np.ones(len(features))
    if standardize:
        mean = train[0, 1:-1] / train[0, 0]
        scale = np.sqrt(np.maximum(np.diag(train)[1:-1] / train[0, 0] - mean**2, 0.0))
        scale[scale == 0] = 1.0
        unit = np.concatenate([[1.0], 1.0 / scale, [1.0]])
        grams = {k: g * np.outer(unit, unit) for k, g in grams.items()}
        holdout, train = holdout * np.outer(unit, unit), train * np.outer(unit, unit)
    grid = []
    for alpha in ALPHAS:
        for ratio in L1_RATIOS:
            errors = [gram_mse(g, *elastic_net(train - g, alpha, ratio)) for g in grams.values()]
            grid.append((alpha, ratio, float(np.mean(errors))))
    alpha, ratio, _ = min(grid, key=lambda row: row[2])
    beta, intercept = elastic_net(train, alpha, ratio)
    spark = df.sparkSession
    coefficients = local_table(spark, {"feature": features, "coefficient": beta.tolist()})
    cv = local_table(
        spark, {"alpha": [g[0] for g in grid], "l1_ratio": [g[1] for g in grid], "mse": [g[2] for g in grid]}
    )
    return ElasticNetResult(
        coefficients, cv, alpha, ratio, gram_mse(holdout, beta, intercept), cull(coefficients, features, threshold)
    )


def cull(coefficients: DataFrame, features: Sequence[str], threshold: float = 0.01) -> Selection:
    """Drop features whose absolute coefficient is under the threshold."""
    kept = {r["feature"] for r in coefficients.filter(F.abs("coefficient") >= threshold).collect()}
    return Selection(list(features), [f for f in features if f in kept])


def holdout_mse(scored: DataFrame, target: str = "y", prediction: str = "p") -> DataFrame:
    error = F.col(target) - F.col(prediction)
    return scored.agg(F.avg(error * error).alias("mse"))


def vector_columns(df: DataFrame, vector_col: str, names: Sequence[str]) -> DataFrame:
    """Open a narrow vector into named double columns."""
    values = vector_to_array(vector_col)
    return df.select("*", *[values[i].alias(n) for i, n in enumerate(names)]).drop(vector_col)


def label_correlations(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """``(feature, coefficient)``: Pearson correlation with the label, in one pass."""
    wide = df.agg(*[F.corr(F.col(f).cast("double"), F.col(label).cast("double")).alias(f"{f}|coefficient") for f in features])
    return _long(wide, [], features, ["coefficient"])
