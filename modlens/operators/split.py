"""Splits, samples and folds.  Each is a small aggregation followed by a map-only filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modlens.operators.ranking import random_key, rank_slices
from modlens.sources.tables import label_columns


def any_label(columns: Sequence[str]) -> Column | None:
    """True where any label is set; none unless a toxicity label is there at all."""
    if not {"toxic", "severe_toxic"} & set(columns):
        return None
    return F.greatest(*[F.coalesce(F.col(c), F.lit(0)) for c in label_columns(columns)], F.lit(0)) > 0


def label_balance(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def train_validation(
    df: DataFrame, strata: Sequence[str] = (), fraction: float = 0.2, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """Column ``part``: the first ``ceil(fraction*n)`` rows of each stratum validate."""
    sliced = rank_slices(df, id_col, seed, {"cut": lambda n: F.ceil(n * fraction)}, strata)
    part = F.when(F.col("slice") == 0, "validation").otherwise("train")
    return sliced.withColumn("part", part).drop("slice")


def split_any_label(df: DataFrame, fraction: float = 0.2, seed: int = 42, id_col: str = "doc_id") -> DataFrame:
    """Stratify by "any label set" where label columns allow it, else split plainly."""
    predicate = any_label(df.columns)
    if predicate is None:
        return train_validation(df, (), fraction, seed, id_col)
    flagged = df.withColumn("any_label", predicate.cast("int"))
    return train_validation(flagged, ["any_label"], fraction, seed, id_col)


def stratified_sample(
    df: DataFrame, strata: Sequence[str], fraction: float, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """``round(fraction*n)`` rows of each stratum."""
    sliced = rank_slices(df, id_col, seed, {"cut": lambda n: F.floor(n * fraction + 0.5)}, strata)
    return sliced.filter("slice = 0").drop("slice")


def capped_sample(
    df: DataFrame, cap: int = 20_000, fraction: float = 0.2, seed: int = 42, id_col: str = "doc_id"
) -> DataFrame:
    """``min(cap, fraction*n)`` rows, uniformly and without replacement: a top-k by random key."""
    k = min(cap, int(df.count() * fraction))
    return df.orderBy(random_key(id_col, seed), id_col).limit(k)


def add_folds(
    df: DataFrame, strata: Sequence[str] = (), folds: int = 5, seed: int = 42, id_col: str = "doc_id",
    fold_col: str = "fold",
) -> DataFrame:
    """Fold number ``floor((rank-1)*folds/n)`` in each stratum's random order."""
    wanted = {str(i): (lambda n, i=i: F.ceil(n * i / folds)) for i in range(1, folds)}
    return rank_slices(df, id_col, seed, wanted, strata, fold_col)


def examples_per_class(df: DataFrame, label: str, n: int = 3, id_col: str = "doc_id") -> DataFrame:
    """First ``n`` rows of each class by id: per-partition candidates, then the final pick.

    The window limit is pushed below the shuffle, so each task sends at most ``n`` rows per class.
    """
    window = Window.partitionBy(label).orderBy(id_col)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)
