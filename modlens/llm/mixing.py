"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are counted per cell of source, language and topic. The cells are raked: their weights are scaled to
one marginal after the other until the weighted token shares of sources, languages and topics all are the targets.
A document's rate is its cell's weight times ``size``, the wanted number of tokens as a share of the corpus's; the
weights average 1 over the tokens, so no cell, however rare, sets what the others keep. A rate up to 1 is the
probability of the document. A cell with a larger rate has too few tokens: all its documents stay (probability 1)
and ``multiplicity`` is the rate; ``copies`` is the rate rounded down or up by the draw. Tokens times copies (as selected
tokens times multiplicity) have the target shares and the wanted size in expectation.

Targets are given as {value: weight} per dimension, or follow from the corpus as share ** ``temper`` (1: as it is, 0:
all alike). Values without a target of their own (in tempered targets: those under ``MIN_SHARE`` of the tokens)
form one group of the dimension, so there are at most 1 / MIN_SHARE + 1 values of each and the cells that the driver
fits are few, whatever the corpus. Documents are never collected.

The topic is the column ``topic`` if there is one; else a stand-in: the longest word of a text (ties: the last in
binary order) hashed to one of ``TOPICS`` groups.

Edge cases: null source, language or topic is a value of its own; null and empty texts count no token and are
sampled like the rest of their cell (by weight 1 if the cell has no token); repeated rows are sampled
alike, since the draw depends on the doc_id alone; null ids draw 0 and stay; other columns of the input are kept.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = ("source", "lang", "topic")
MIN_SHARE = 0.001
TOPICS = 8
SWEEPS = 500
NULL, REST = "\x00null", "\x00rest"
_BREAKS = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text; the pieces at its ends may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAKS)


def n_tokens(words: Column) -> Column:
    return (F.size(words) - F.size(F.filter(words, lambda w: w == ""))).cast("long")


def topic_of(words: Column) -> Column:
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return (F.conv(F.substring(F.md5(longest.cast("binary")), 1, 4), 16, 10).cast("int") % TOPICS).cast("string")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1), from the id."""
    digest = F.md5(F.concat_ws("|", doc_id.cast("string"), F.lit(str(seed))).cast("binary"))
    return F.coalesce(F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12), F.lit(0.0))


def rake(index: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Weights of the cells. index: a column of value numbers for each dimension; targets: shares by number.
    Targets of values without tokens are left out and the rest of the dimension is scaled up to 1."""
    fitted = tokens / tokens.sum()
    goals = []
    for k, target in enumerate(targets):
        present = np.bincount(index[:, k], fitted, len(target)) > 0
        goal = np.where(present, target, 0.0)
        if goal.sum() == 0:
            goal = present.astype(np.float64)
        goals.append(goal / goal.sum())
    for _ in range(SWEEPS):
        worst = 0.0
        for k, goal in enumerate(goals):
            now = np.bincount(index[:, k], fitted, len(goal))
            worst = max(worst, np.abs(now - goal).max())
            fitted = fitted * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[index[:, k]]
        if worst < 1e-12:
            break
    return np.divide(fitted * tokens.sum(), tokens, out=np.ones_like(fitted), where=tokens > 0)


def cell_weights(
    rows: DataFrame, temper: float, targets: Mapping[str, Mapping[str, float]] | None
) -> tuple[list[tuple], dict[str, list[str]]]:
    """([(source, lang, topic, weight)], values with a group of their own by dimension) from rows of the three
    columns and n_tokens."""
    goals: dict[str, dict[str, float]] = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            goals[d] = {NULL if k is None else str(k): float(v) for k, v in targets[d].items()}
            goals[d].setdefault(REST, 0.0)
            continue
        sums = rows.groupBy(d).agg(F.sum("n_tokens").alias("n"))
        total = sums.agg(F.sum("n")).first()[0] or 0
        large = {r[0]: r["n"] / total for r in sums.where(F.col("n") >= MIN_SHARE * total).where("n > 0").collect()}
        rest = max(0.0, 1 - sum(large.values()))
        goals[d] = {k: v**temper for k, v in large.items()} | {REST: rest**temper if rest > 1e-12 else 0.0}
    own = {d: sorted(k for k in g if k != REST) for d, g in goals.items()}
    grouped = rows.select(*(group_of(F.col(d), own[d]).alias(d) for d in DIMENSIONS), "n_tokens")
    cells = grouped.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("n")).orderBy(*DIMENSIONS).collect()
    tokens = np.array([r["n"] for r in cells], dtype=np.float64)
    if not len(cells) or tokens.sum() == 0:
        return [(*r[:3], 1.0) for r in cells], own
    order = {d: {v: i for i, v in enumerate([*own[d], REST])} for d in DIMENSIONS}
    index = np.array([[order[d][r[d]] for d in DIMENSIONS] for r in cells])
    weights = rake(index, tokens, [np.array([goals[d][v] for v in [*own[d], REST]]) for d in DIMENSIONS])
    return [(*r[:3], float(w)) for r, w in zip(cells, weights, strict=True)], own


def group_of(value: Column, own: list[str]) -> Column:
    return F.when(value.isin(own), value).otherwise(F.lit(REST)) if own else F.lit(REST)


def chances(rate: float) -> tuple[float, float]:
    """Probability and multiplicity of a rate. Raking leaves rates of 1 off by rounding."""
    return (1.0, rate if rate > 1 + 1e-9 else 1.0) if rate > 1 - 1e-9 else (rate, 1.0)


def mixing(
    docs: DataFrame,
    temper: float = 0.9,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    seed: int = 7,
    size: float = 1.0,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The documents with the columns topic, n_tokens, weight, probability, multiplicity, selected and copies.

    ``keep`` names the columns of the documents that the result has (all). The text is read once: they are written
    with topic and count, and cells and draw read that table.
    """
    spark = docs.sparkSession
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NULL))
    added = ("topic", "n_tokens", "weight", "probability", "multiplicity", "selected", "copies")
    kept = [c for c in docs.columns if c not in added and (keep is None or c in keep)]
    split = docs.select(
        *kept, *(value(F.col(d)).alias(f"__mix_{d}") for d in DIMENSIONS[:2]),
        *([value(F.col("topic")).alias("__mix_topic")] if "topic" in docs.columns else []),
        words_of(F.col("text")).alias("__mix_words"),
    )
    topic = F.col("__mix_topic") if "topic" in docs.columns else topic_of(F.col("__mix_words"))
    counted = written(split.select(
        *kept, *(F.col(f"__mix_{d}") for d in DIMENSIONS[:2]), topic.alias("topic"), n_tokens(F.col("__mix_words")).alias("n_tokens")
    ), "counted")
    columns = {"source": F.col("__mix_source"), "lang": F.col("__mix_lang"), "topic": F.col("topic")}
    sums = counted.select(*(c.alias(d) for d, c in columns.items()), "n_tokens").groupBy(*DIMENSIONS)
    cells, own = cell_weights(written(sums.agg(F.sum("n_tokens").alias("n_tokens")), "cells"), temper, targets)
    names = [f"__cell_{d}" for d in DIMENSIONS]
    table = spark.createDataFrame(
        [(*c[:3], c[3], *chances(size * c[3])) for c in cells],
        ", ".join([*(f"{n} string" for n in names), "weight double", "probability double", "multiplicity double"]),
    )
    keyed = counted.select(
        *kept, "topic", "n_tokens", *(group_of(c, own[d]).alias(n) for (d, c), n in zip(columns.items(), names, strict=True)),
    )
    joined = keyed.join(F.broadcast(table), names).drop(*names)  # cells: few, see above
    drawn, rate = draw(F.col("doc_id"), seed), F.col("probability") * F.col("multiplicity")
    return joined.withColumn("selected", drawn < F.col("probability")).withColumn(
        "copies", (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")
    )
