"""Whole jobs: feature extraction, training with a resampling contest, threshold tuning."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.operators import ensemble, evaluate, models, resample, search, select, split
from modlens.operators.combine import FeatureConfig, FeatureExtractor, FeatureModel
from modlens.operators.reduce import reduce_dimensions
from modlens.sources.tables import FeatureStore, ModelRegistry, local_table, materialise


@dataclass
class JobConfig:
    """Settings of a training run."""

    target: str = "toxic"
    seed: int = 42
    test_size: float = 0.2
    sample_fraction: float = 1.0
    reduction: str | None = "pca"
    components: int | None = None
    resampling: str | None = None  # None: hold the contest
    debug: bool = False
    folds: int = 5
    parallelism: int = 4
    save_path: str | None = None
    models: Sequence[str] = field(default_factory=lambda: list(models.TRAINERS))


# Feature job -----------------------------------------------------------------------------------------


def extract_features(spark: SparkSession, comments: DataFrame, store: str, config: FeatureConfig = FeatureConfig(),
                     text_col: str = "text", id_col: str = "doc_id", source: str = "") -> DataFrame:
    """Feature table of a comment table, built once per configuration and source."""
    key = {"config": repr(config), "source": source}

    def build() -> DataFrame:
        return FeatureExtractor(config).fit(comments, text_col, id_col).transform(comments, text_col, id_col)

    return FeatureStore(spark, store).get_or_build("features", key, build)


def split_extract(comments: DataFrame, label: str, config: FeatureConfig = FeatureConfig(), text_col: str = "text",
                  id_col: str = "doc_id") -> tuple[FeatureModel, DataFrame, DataFrame]:
    """Split first, fit the families on the training part only, apply them to both parts."""
    parts = split.train_validation(comments, [label], id_col=id_col)
    train, test = parts.filter("part = 'train'"), parts.filter("part = 'validation'")
    model = FeatureExtractor(config).fit(train, text_col, id_col)

    def vectors(part: DataFrame) -> DataFrame:
        rows = model.transform(part, text_col, id_col).join(part.select(id_col, label), id_col)
        return materialise(rows.select(id_col, "features", F.col(label).cast("double").alias("label")), "vectors")

    return model, vectors(train), vectors(test)


def regularise(df: DataFrame, features: Sequence[str], target: str, threshold: float = 0.01, alpha: float = 0.05,
               correlation: float = 0.4, id_col: str = "doc_id", **options) -> dict:
    """Correlations, normality and elastic-net culling of a wide feature table in one call."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    result = select.elastic_net_selection(df, features, target, threshold, id_col=id_col, **options)
    return {
        "correlations": select.correlated_pairs(df, features, correlation),
        "normality": select.normality(long, alpha),
        "selection": result,
        "data": result.selection.apply(df),
    }


# Training job ----------------------------------------------------------------------------------------


def _rows_to_arrays(df: DataFrame, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))


def _arrays_to_rows(df: DataFrame) -> DataFrame:
    return df.select("id", array_to_vector("x").alias("features"), F.col("y").cast("double").alias("label"))


def resampling_contest(train: DataFrame, test: DataFrame, fraction: float = 0.2, cap: int = 20_000, seed: int = 42,
                       methods: Sequence[str] = tuple(resample.METHODS)) -> tuple[DataFrame, str]:
    """Resample a sample by each method, fit logistic regression, compare F1; the first best wins.

    ``train`` and ``test`` are ``(id, x, y)``; ``test`` should be a validation part, not the final test.
    """
    sample = materialise(split.capped_sample(train, cap, fraction, seed, "id"), "contest-sample")
    held = _arrays_to_rows(test)
    rows = []
    for method in methods:
        resampled = materialise(_arrays_to_rows(resample.resample(sample, method, seed)), f"contest-{method}", even=True)
        counts = {int(r["label"]): r["count"] for r in resampled.groupBy("label").count().collect()}
        if len(counts) < 2:
            rows.append((method, 0.0, counts.get(0, 0), counts.get(1, 0)))
            continue
        model = models.logistic(resampled, max_iter=1000, standardise=False)
        c = evaluate.outcome_counts(models.score(model, held, "id", method)).first()
        base = 2 * c["tp"] + c["fp"] + c["fn"]
        rows.append((method, 2 * c["tp"] / base if base else 0.0, counts.get(0, 0), counts.get(1, 0)))
    names = ("method", "f1", "negatives", "positives")
    schema = pa.schema([("method", pa.string()), ("f1", pa.float64()), ("negatives", pa.int64()), ("positives", pa.int64())])
    best = max(rows, key=lambda r: r[1])[0]
    return local_table(train.sparkSession, {n: [r[i] for r in rows] for i, n in enumerate(names)}, schema), best


def preprocess(train: DataFrame, test: DataFrame, config: JobConfig, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame, str]:
    """Reduce dimensions, choose a resampling method on a validation fold, resample the training rows."""
    a, b = _rows_to_arrays(train, id_col), _rows_to_arrays(test, id_col)
    if config.reduction:
        a, b, _ = reduce_dimensions(a, b, config.reduction, config.components)
    a, b = materialise(a, "reduced-train", even=True), materialise(b, "reduced-test", even=True)
    method = config.resampling
    if method is None:
        parts = split.train_validation(a, ["y"], config.test_size, config.seed, "id")
        fit_part, check_part = (parts.filter(f"part = '{p}'").drop("part") for p in ("train", "validation"))
        _, method = resampling_contest(fit_part, check_part, seed=config.seed)
    grown = materialise(_arrays_to_rows(resample.resample(a, method, config.seed)), "resampled", even=True)
    return grown.withColumnRenamed("id", id_col), _arrays_to_rows(b).withColumnRenamed("id", id_col), method


@dataclass
class TrainingResult:
    models: dict
    scores: DataFrame  # (model, id, label, p) on the test rows
    metrics: DataFrame  # (model, accuracy, f1, roc_auc)
    status: DataFrame  # (model, state, detail)
    validation_f1: dict[str, float]
    resampling: str


def train_and_evaluate(features: DataFrame, config: JobConfig = JobConfig(), id_col: str = "doc_id",
                       spaces: dict | None = None) -> TrainingResult:
    """Split, preprocess, tune each chosen model, build the ensembles, evaluate, save.

    ``features`` has ``(id, features, label)``.  An unknown or failing model is recorded and skipped.
    """
    spark = features.sparkSession
    if config.sample_fraction < 1:
        features = split.stratified_sample(features, ["label"], config.sample_fraction, config.seed, id_col)
    parts = split.train_validation(features, ["label"], config.test_size, config.seed, id_col)
    train, test, method = preprocess(
        parts.filter("part = 'train'").drop("part"), parts.filter("part = 'validation'").drop("part"), config, id_col
    )
    spaces = spaces or (search.DEBUG_SPACES if config.debug else search.SPACES)
    fitted, found, validation, status = {}, {}, {}, []
    for name in config.models:
        if name not in models.TRAINERS:
            status.append((name, "unknown", ""))
            continue
        try:
            result = search.halving_search(
                train, name, spaces[name], config.folds, config.seed, config.parallelism, id_col
            )
        except Exception as error:
            status.append((name, "failed", str(error)[:200]))
            continue
        fitted[name], found[name], validation[name] = result.model, result.params, result.score
        status.append((name, "trained", str(result.params)))
    if not fitted:
        raise ValueError(f"no model could be trained: {status}")
    members = materialise(ensemble.member_scores(fitted, test, id_col), "member-scores")
    columns = members.columns
    scores, ensembles = [members], {}
    if len(fitted) >= 2:
        weights = ensemble.weight_table(spark, validation)
        stack = ensemble.stack(
            train, {n: _refit(n, found[n]) for n in fitted}, config.folds, config.seed, id_col
        )
        scores += [
            ensemble.soft_vote(members, list(fitted), id_col).select(columns),
            ensemble.weighted_vote(members, weights, id_col).select(columns),
            stack.score(test, id_col).select(columns),
        ]
        ensembles = {
            "voting": ensemble.Voting(fitted), "weighted_voting": ensemble.Voting(fitted, validation), "stacking": stack,
        }
    all_scores = materialise(reduce(DataFrame.unionByName, scores), "scores")
    metrics = materialise(evaluate.eval_metrics(all_scores), "metrics")
    table = local_table(spark, {k: [s[i] for s in status] for i, k in enumerate(("model", "state", "detail"))})
    if config.save_path:
        reports = {
            "status": table, "confusion": evaluate.confusion(all_scores), "class_report": evaluate.class_report(all_scores),
        }
        ModelRegistry(spark, config.save_path).save(fitted, metrics, ensembles, reports)
    return TrainingResult(fitted, all_scores, metrics, table, validation, method)


def _refit(name: str, params: dict) -> Callable[[DataFrame], object]:
    return lambda df: models.TRAINERS[name](df, **params)


# Threshold job -----------------------------------------------------------------------------------------


def tune_threshold(registry: ModelRegistry, data: DataFrame | None, id_col: str = "doc_id", rows: int | None = None,
                   custom: float | None = None) -> tuple[str, float]:
    """Best model and threshold on a table, or on its first ``rows`` rows by id; a given threshold wins.

    Without data the model of the best stored F1 and the default threshold are used.
    """
    fitted, metrics = registry.load()
    best = evaluate.best_model(metrics.filter(F.col("model").isin(*fitted))).first()
    name, optimised = best["model"], None
    if data is not None:
        first = materialise(data.orderBy(id_col).limit(rows) if rows else data, "threshold-rows")
        row = evaluate.best_overall(ensemble.member_scores(fitted, first, id_col)).first()
        name, optimised = row["model"], row["threshold"]
    return name, evaluate.effective_threshold(custom, optimised)
