"""Successive halving over random candidates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modlens.operators.evaluate import outcome_counts
from modlens.operators.models import TRAINERS, score
from modlens.operators.ranking import rank_slices
from modlens.operators.split import add_folds
from modlens.operators.trees import Forest
from modlens.sources.tables import local_table, materialise

FACTOR = 3
MIN_ROWS = 1500
MAX_ROWS = 50_000


@dataclass(frozen=True)
class Uniform:
    low: float
    high: float


@dataclass(frozen=True)
class LogUniform:
    low: float
    high: float


@dataclass(frozen=True)
class Integers:
    """Integers from ``low`` up to, but not including, ``high``."""

    low: int
    high: int


DEPTHS = [None, *range(5, 50, 5)]
_FOREST = {
    "n_estimators": Integers(50, 500),
    "max_depth": DEPTHS,
    "min_samples_leaf": Integers(1, 10),
    "max_features": ["sqrt", "log2", None],
    "bootstrap": [True, False],
    "class_weight": ["balanced", None],
}
SPACES: dict[str, dict] = {
    "random_forest": _FOREST,
    "extra_trees": _FOREST,
    "gradient_boosting": {
        "n_estimators": Integers(50, 500),
        "learning_rate": LogUniform(0.001, 0.5),
        "max_depth": Integers(3, 15),
        "min_samples_leaf": Integers(1, 10),
        "subsample": Uniform(0.6, 1.0),
        "max_features": ["sqrt", "log2", None],
    },
    "svm": {
        "c": LogUniform(0.1, 100),
        "gamma": LogUniform(1e-5, 1),
        "kernel": ["linear", "rbf"],
        "balanced": [True, False],
    },
    "xgboost": {
        "n_estimators": Integers(50, 500),
        "max_depth": Integers(3, 15),
        "learning_rate": LogUniform(0.001, 0.5),
        "subsample": Uniform(0.6, 1.0),
        "colsample_bytree": Uniform(0.6, 1.0),
        "gamma": Uniform(0, 5),
        "min_child_weight": Integers(1, 10),
    },
    "lightgbm": {
        "n_estimators": [50, 100, 200],
        "max_depth": [3, 6, 9],
        "learning_rate": [0.01, 0.05, 0.1],
        "subsample": [0.7, 0.8, 0.9],
        "colsample_bytree": [0.7, 0.8, 0.9],
        "num_leaves": [31, 63],
        "min_child_samples": [20],
    },
    "adaboost": {"n_estimators": Integers(50, 500), "learning_rate": LogUniform(0.001, 1)},
}
_SMALL_FOREST = {
    "n_estimators": [50, 100],
    "max_depth": [None, 10, 20],
    "min_samples_leaf": [1, 2],
    "max_features": ["sqrt"],
    "bootstrap": [True],
    "class_weight": ["balanced", None],
}
# Small grids for trial runs.
DEBUG_SPACES: dict[str, dict] = {
    "random_forest": _SMALL_FOREST,
    "extra_trees": _SMALL_FOREST,
    "gradient_boosting": {
        "n_estimators": [50, 100],
        "learning_rate": [0.01, 0.1],
        "max_depth": [3, 5],
        "min_samples_leaf": [1, 2],
        "subsample": [0.8, 1.0],
        "max_features": ["sqrt"],
    },
    "svm": {"c": [0.1, 1.0, 10.0], "gamma": ["scale", "auto"], "kernel": ["linear", "rbf"], "balanced": [True, False]},
    "xgboost": {
        "n_estimators": [50, 100],
        "max_depth": [3, 6, 9],
        "learning_rate": [0.01, 0.1],
        "subsample": [0.8, 1.0],
        "colsample_bytree": [0.8, 1.0],
        "gamma": [0, 1],
    },
    "lightgbm": {
        "n_estimators": [50, 100],
        "max_depth": [3, 6, 9],
        "learning_rate": [0.01, 0.1],
        "subsample": [0.8, 1.0],
        "colsample_bytree": [0.8, 1.0],
        "num_leaves": [31, 63, 127],
    },
    "adaboost": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1, 1.0]},
}
# Parameters of the original search spaces without a Spark counterpart.
DROPPED = {
    "random_forest": ["min_samples_split", "balanced_subsample"],
    "extra_trees": ["min_samples_split", "balanced_subsample"],
    "gradient_boosting": ["min_samples_split"],
    "svm": ["probability"],
    "lightgbm": ["reg_alpha"],
    "adaboost": ["algorithm"],
}


def draw_candidates(space: Mapping[str, object], n: int, seed: int = 42) -> list[dict]:
    """``n`` random parameter settings."""
    rng = np.random.RandomState(seed)

    def pick(dist):
        if isinstance(dist, Uniform):
            return float(rng.uniform(dist.low, dist.high))
        if isinstance(dist, LogUniform):
            return float(np.exp(rng.uniform(np.log(dist.low), np.log(dist.high))))
        if isinstance(dist, Integers):
            return int(rng.randint(dist.low, dist.high))
        return dist[rng.randint(len(dist))]

    return [{k: pick(d) for k, d in space.items()} for _ in range(n)]


@dataclass(frozen=True)
class Rung:
    number: int
    rows: int
    candidates: int


def halving_schedule(n: int, factor: int = FACTOR, min_rows: int = MIN_ROWS, max_rows: int = MAX_ROWS) -> list[Rung]:
    """Rows and candidates per round; small tables start from a third of their rows."""
    top = min(max_rows, n)
    low = max(1, min(min_rows, n // factor))
    first = max(1, top // low)
    rounds = 1
    while first >= factor**rounds:
        rounds += 1
    return [Rung(i, low * factor**i, math.ceil(first / factor**i)) for i in range(rounds)]


def schedule_table(counted: DataFrame, factor: int = FACTOR, min_rows: int = MIN_ROWS, max_rows: int = MAX_ROWS) -> DataFrame:
    """The schedule as rows, from a table with the row count in ``n``."""
    top = F.least(F.lit(max_rows).cast("bigint"), F.col("n"))
    low = F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(min_rows).cast("bigint"), F.floor(F.col("n") / factor)))
    first = F.greatest(F.lit(1).cast("bigint"), F.floor(top / low))
    steps = F.sequence(F.lit(0), F.lit(20))
    return (
        counted.select(low.alias("low"), first.alias("first"))
        .select("low", "first", F.explode(steps).alias("rung"))
        .withColumn("power", F.pow(F.lit(float(factor)), "rung").cast("bigint"))
        .filter(F.col("power") <= F.col("first"))
        .select(
            "rung",
            (F.col("low") * F.col("power")).alias("rows"),
            F.ceil(F.col("first") / F.col("power")).alias("candidates"),
        )
    )


def survivors(scores: DataFrame, factor: int = FACTOR, by: Sequence[str] = ()) -> DataFrame:
    """The best ``ceil(n/factor)`` candidates by mean score, ties (to nine digits) by name.

    There are as many rows as candidates, never as many as data rows.
    """
    means = scores.groupBy(*by, "candidate").agg(F.round(F.avg("score"), 9).alias("score"))
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("score"), "candidate")
    size = Window.partitionBy(*(by or [F.lit(0)]))
    ranked = means.withColumn("rank", F.row_number().over(order)).withColumn("n", F.count("*").over(size))
    return ranked.filter(F.col("rank") <= F.ceil(F.col("n") / factor)).select(*by, "candidate", "score", "rank")


@dataclass
class SearchResult:
    name: str
    params: dict
    score: float
    model: PipelineModel
    trace: DataFrame  # (rung, rows, candidate, params, score)


def fold_f1(trainer, params: dict, data: DataFrame, folds: int, id_col: str) -> float:
    """Mean F1 over the folds of ``data``."""
    values = []
    for f in range(folds):
        model = trainer(data.filter(F.col("fold") != f), **params)
        row = outcome_counts(score(model, data.filter(F.col("fold") == f), id_col, "m")).first()
        denominator = 2 * row["tp"] + row["fp"] + row["fn"] if row else 0
        values.append(2 * row["tp"] / denominator if denominator else 0.0)
        for stage in model.stages:
            if isinstance(stage, Forest):
                stage.release()
    return float(np.mean(values))


def halving_search(
    df: DataFrame,
    name: str,
    space: Mapping[str, object] | None = None,
    folds: int = 5,
    seed: int = 42,
    parallelism: int = 4,
    id_col: str = "doc_id",
    schedule: Sequence[Rung] | None = None,
) -> SearchResult:
    """Random search in rounds: few rows for many candidates, then more rows for the best third.

    ``df`` has ``features`` and ``label``.  A round's rows are the first of one stratified random
    order, so each sample contains the one before; candidates are fitted as concurrent Spark jobs.
    """
    trainer = TRAINERS[name]
    n = df.count()
    schedule = list(schedule or halving_schedule(n))
    candidates = dict(enumerate(draw_candidates(space or SPACES[name], schedule[0].candidates, seed)))
    trace: list[tuple] = []
    ranked: list[int] = list(candidates)
    for rung in schedule:
        share = min(1.0, rung.rows / n)
        sample = rank_slices(df, id_col, seed, {"cut": lambda m, s=share: F.ceil(m * s)}, ["label"], "_after")
        data = materialise(
            add_folds(sample.filter("_after = 0").drop("_after"), ["label"], folds, seed, id_col), "rung", even=True
        )
        running = ranked[: rung.candidates]
        with ThreadPoolExecutor(parallelism) as pool:
            results = list(pool.map(lambda c: fold_f1(trainer, candidates[c], data, folds, id_col), running))
        trace += [(rung.number, rung.rows, c, str(candidates[c]), s) for c, s in zip(running, results, strict=True)]
        ranked = [c for c, _ in sorted(zip(running, results, strict=True), key=lambda cs: (-cs[1], cs[0]))]
    best = ranked[0]
    schema = pa.schema(
        [("rung", pa.int32()), ("rows", pa.int64()), ("candidate", pa.int32()), ("params", pa.string()), ("score", pa.float64())]
    )
    columns = {f.name: [t[i] for t in trace] for i, f in enumerate(schema)}
    best_score = next(t[4] for t in reversed(trace) if t[2] == best)
    return SearchResult(
        name, candidates[best], best_score, trainer(df, **candidates[best]), local_table(df.sparkSession, columns, schema)
    )
