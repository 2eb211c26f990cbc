"""Voting and stacking over member scores ``(model, doc_id, label, p)``."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.operators.models import assemble, logistic, score
from modlens.operators.split import add_folds
from modlens.sources.tables import local_table, materialise

ENSEMBLES = ("voting", "weighted_voting", "stacking")


def member_scores(models: Mapping[str, PipelineModel], df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Scores of all members, one below the other."""
    parts = [score(m, df, id_col, name) for name, m in models.items() if name not in ENSEMBLES]
    return reduce(DataFrame.unionByName, parts)


def _vote(scores: DataFrame, weight: Column, name: str, id_col: str) -> DataFrame:
    p = F.sum(F.col("p") * weight) / F.sum(weight)
    return scores.groupBy(id_col).agg(F.max("label").alias("label"), p.alias("p")).select(
        F.lit(name).alias("model"), id_col, "label", "p", (F.col("p") >= 0.5).cast("int").alias("pred")
    )


def soft_vote(scores: DataFrame, members: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """Mean probability; needs at least two members."""
    if len(members) < 2:
        raise ValueError("voting needs at least two models")
    return _vote(scores.filter(F.col("model").isin(*members)), F.lit(1.0), "voting", id_col)


def weighted_vote(scores: DataFrame, weights: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Probability weighted by each member's validation score ``(model, weight)``, 1 if it has none."""
    weighted = scores.filter(~F.col("model").isin(*ENSEMBLES)).join(weights, "model", "left")
    return _vote(weighted, F.coalesce("weight", F.lit(1.0)), "weighted_voting", id_col)


@dataclass
class Voting:
    """Mean or weighted mean of the members' probabilities."""

    members: dict[str, PipelineModel]
    weights: dict[str, float] | None = None

    def score(self, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
        scores = member_scores(self.members, df, id_col)
        if self.weights is None:
            return soft_vote(scores, list(self.members), id_col)
        return weighted_vote(scores, weight_table(df.sparkSession, self.weights), id_col)

    def save(self, spark: SparkSession, path: str) -> None:
        _save_head(spark, path, {"members": list(self.members), "weights": self.weights})

    @classmethod
    def load(cls, spark: SparkSession, path: str, models: Mapping[str, PipelineModel]) -> Voting:
        head = _load_head(spark, path)
        return cls({m: models[m] for m in head["members"]}, head["weights"])


def _save_head(spark: SparkSession, path: str, head: dict) -> None:
    local_table(spark, {"head": [json.dumps(head)]}).write.mode("overwrite").parquet(f"{path}/head")


def _load_head(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/head").first()["head"])


@dataclass
class Stack:
    members: dict[str, PipelineModel]
    meta: PipelineModel
    out_of_fold: DataFrame | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Meta-learner and members: these were fitted again for the stack, so they are models of their own."""
        _save_head(spark, path, {"members": list(self.members)})
        self.meta.write().overwrite().save(f"{path}/meta")
        for name, model in self.members.items():
            model.write().overwrite().save(f"{path}/members/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, models: Mapping[str, PipelineModel]) -> Stack:
        names = _load_head(spark, path)["members"]
        return cls({m: PipelineModel.load(f"{path}/members/{m}") for m in names}, PipelineModel.load(f"{path}/meta"))

    def score(self, df: DataFrame, id_col: str = "doc_id") -> DataFrame:
        wide = widen(member_scores(self.members, df, id_col), list(self.members), id_col)
        return score(self.meta, assemble(wide, list(self.members), "label", id_col), id_col, "stacking")


def widen(scores: DataFrame, members: Sequence[str], id_col: str) -> DataFrame:
    """One column per member; the member list is given, so no pass is needed to find it."""
    return scores.groupBy(id_col, "label").pivot("model", list(members)).agg(F.first("p"))


def stack(
    df: DataFrame, trainers: Mapping[str, Callable[[DataFrame], PipelineModel]], folds: int = 5, seed: int = 42,
    id_col: str = "doc_id",
) -> Stack:
    """Logistic regression on out-of-fold member probabilities; members are then refitted on all rows."""
    trainers = {k: v for k, v in trainers.items() if k not in ENSEMBLES}
    data = materialise(add_folds(df, ["label"], folds, seed, id_col), "stack", even=True)
    parts = []
    for f in range(folds):
        train, held = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        parts += [score(fit(train), held, id_col, name) for name, fit in trainers.items()]
    out_of_fold = materialise(widen(reduce(DataFrame.unionByName, parts), list(trainers), id_col), "out-of-fold", even=True)
    meta = logistic(assemble(out_of_fold, list(trainers), "label", id_col), max_iter=1000, standardise=False)
    return Stack({name: fit(data) for name, fit in trainers.items()}, meta, out_of_fold)


def weight_table(spark, weights: Mapping[str, float]) -> DataFrame:
    return local_table(spark, {"model": list(weights), "weight": [float(w) for w in weights.values()]})
