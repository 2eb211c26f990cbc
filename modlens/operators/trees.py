"""Tree ensembles that Spark ML lacks: regularised boosting, leaf-wise boosting, extremely randomised trees.

All three grow from the same aggregation. Features become bins of at most 256 values, one byte each, written once.
A pass scans that table, sums per (node, feature, bin) inside the task, and one shuffle of those cells merges the
sums; gains are taken over the merged cells, and a row per node and task reaches the driver. So a pass costs one scan, and
what is shuffled depends on nodes, features and bins, not on rows. Gradients are integers (multiples of 2^-30): sums are
exact, do not depend on the order of partitions, and a recomputed task gives the same tree.

Rows without a label take no part. NaN goes to the right of every cut. A table without rows, or with one value in
every feature, gives trees of one leaf.
"""

from __future__ import annotations

import heapq
import json
import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modlens.sources.tables import local_table, materialise, release

BINS = 256
SCALE = 1 << 30
STORE_EVERY = 8  # rounds between two writes of the margins
CELLS = 1 << 22  # cells that a task holds at once; larger frontiers take several passes
ENTRIES = 1 << 21  # row-feature entries counted at once
MERGED = 1 << 18  # merged cells aimed at in a task
LEAST_GAIN = 1e-6
GROWN = 1 << 24  # bytes of a node's rows that one task grows to the end
MOST_TASKS = 4096  # that such nodes are dealt to
PART = 1 << 25  # bytes of a forest that the driver holds at once when it sends it to the tasks
# Arrays of what grew below a node, and those that scoring needs.
PIECE = {"feature": np.int32, "cut": np.uint8, "left": np.int32, "value": np.float64, "gain": np.float64}
SCORED = ["feature", "cut", "left", "value"]
CELL_SCHEMA = "node int, feature int, bin int, n bigint, g bigint, h bigint"
BEST = "node bigint, feature bigint, bin bigint, nl bigint, gl bigint, hl bigint, n bigint, g bigint, h bigint, gain double"


# --- bins ---------------------------------------------------------------------------------------------------------


def cut_points(df: DataFrame, size: int, max_bins: int = BINS) -> list[list[float]]:
    """At most ``max_bins - 1`` quantiles of each of ``size`` features; a row goes left of a cut it does not exceed."""
    shares = [i / max_bins for i in range(1, max_bins)]
    value = F.posexplode(vector_to_array("features")).alias("feature", "value")
    cuts = (
        df.select(value).where(~F.isnan("value")).groupBy("feature")
        .agg(F.array_sort(F.array_distinct(F.percentile_approx("value", shares, 10_000))).alias("cuts"))
    )
    found = {r["feature"]: r["cuts"] for r in cuts.collect()}
    return [found.get(f, []) for f in range(size)]


def _bytes(column: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), size)


def binned(df: DataFrame, cuts: Sequence[Sequence[float]], margin: float = 0.0, weight: Column | None = None) -> DataFrame:
    """(row, y, w, margin, bins): the written table that all passes scan."""
    edges = [np.asarray(c, dtype=np.float64) for c in cuts]
    size = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, size)
            out = np.empty((n, size), dtype=np.uint8)
            for f, edge in enumerate(edges):
                out[:, f] = np.searchsorted(edge, x[:, f], side="left")
            bins = pa.array([r.tobytes() for r in out], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "y", "w")), pa.array(np.full(n, margin)), bins],
                names=["row", "y", "w", "margin", "bins"],
            )

    rows = df.where("label is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("label").cast("double").alias("y"),
        (F.lit(1.0) if weight is None else weight).cast("double").alias("w"), vector_to_array("features").alias("x"),
    )
    out = rows.mapInArrow(run, "row bigint, y double, w double, margin double, bins binary")
    # A file for each slot: the rows are so short that files of Spark's advisory size would leave most slots idle.
    return materialise(out.repartition(df.sparkSession.sparkContext.defaultParallelism), "binned")


# --- trees --------------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as arrays; ``left`` is -1 in a leaf, and the right child follows the left one."""

    feature: list[int]
    cut: list[int]
    threshold: list[float]
    left: list[int]
    value: list[float]
    gain: list[float]


def walk(table: np.ndarray, feature: np.ndarray, limit: np.ndarray, left: np.ndarray, root: int = 0) -> np.ndarray:
    """The node where each row ends up."""
    at = np.full(len(table), root, dtype=np.int64)
    moving = np.arange(len(table)) if left[root] >= 0 else np.empty(0, dtype=np.int64)
    while len(moving):
        node = at[moving]
        at[moving] = left[node] + ~(table[moving, feature[node]] <= limit[node])
        moving = moving[left[at[moving]] >= 0]
    return at


def _arrays(tree: Tree, limit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind = np.int64 if limit == "cut" else np.float64
    return np.array(tree.feature), np.array(getattr(tree, limit), dtype=kind), np.array(tree.left)


def margins(table: np.ndarray, trees: Sequence[Tree], limit: str) -> np.ndarray:
    """Sum of the trees' leaf values."""
    total = np.zeros(len(table))
    for tree in trees:
        total += np.array(tree.value)[walk(table, *_arrays(tree, limit))]
    return total


class TreeEnsemble(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Probability of class 1: the logistic of the summed leaf values, or their mean (``link``)."""

    trees = Param(Params._dummy(), "trees", "json list of trees", TypeConverters.toString)
    link = Param(Params._dummy(), "link", "logistic or mean", TypeConverters.toString)
    start = Param(Params._dummy(), "start", "margin before the first tree", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, trees="[]", link="logistic", start=0.0, size=0):
        super().__init__()
        self._setDefault(trees="[]", link="logistic", start=0.0, size=0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def members(self) -> list[Tree]:
        return [Tree(**t) for t in json.loads(self.getOrDefault(self.trees))]

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the summed gains of each feature's splits."""
        total = np.zeros(self.getOrDefault(self.size))
        for tree in self.members():
            for feature, left, gain in zip(tree.feature, tree.left, tree.gain, strict=True):
                total[feature] += gain if left >= 0 else 0.0
        return DenseVector(total / (total.sum() or 1.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, start = self.members(), self.getOrDefault(self.start)
        logistic = self.getOrDefault(self.link) == "logistic"

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            total = start + margins(np.stack(x.to_numpy()), trees, "threshold")
            return pd.Series(1 / (1 + np.exp(-total)) if logistic else total / max(len(trees), 1))

        return df.withColumn(self.getOutputCol(), probability(vector_to_array(self.getInputCol())))


# --- the aggregation ----------------------------------------------------------------------------------------------


def uniform(row: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) of each row and seed."""
    x = row.astype(np.uint64) + np.uint64(seed + 1) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0**64


def _whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE).astype(np.int64)


def sums(batches: Iterator[pa.RecordBatch], size: int, wanted: Sequence[int], subsets: np.ndarray,
         placed: Callable) -> Iterator[pa.RecordBatch]:
    """Cells of a task: rows, gradients and curvatures per wanted node, feature of its subset, and bin.

    ``placed(batch, bins)`` yields ``(node, g, h)`` arrays, one triple per tree; rows of other nodes are left out.
    """
    k = subsets.shape[1]
    position = np.full(max(wanted) + 1, -1)
    position[list(wanted)] = np.arange(len(wanted))
    total = np.zeros((3, len(wanted) * k * BINS), dtype=np.int64)
    for batch in batches:
        bins = _bytes(batch.column("bins"), size)
        for node, g, h in placed(batch, bins):
            at = np.where(node < len(position), position[np.minimum(node, len(position) - 1)], -1)
            rows = np.flatnonzero(at >= 0)
            step = max(1, ENTRIES // k)
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                where = at[part]
                cell = ((where[:, None] * k + np.arange(k)) * BINS + bins[part[:, None], subsets[where]]).ravel()
                first, end = cell.min(), cell.max() + 1  # nodes of one tree lie next to each other
                cell -= first
                # Sums of a step stay below 2^53, so they are exact in doubles too.
                total[0, first:end] += np.bincount(cell)
                for j, values in ((1, g), (2, h)):
                    total[j, first:end] += np.bincount(cell, np.repeat(values[part], k)).astype(np.int64)
    cell = np.flatnonzero(total[0])
    which, feature = np.divmod(cell // BINS, k)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.asarray(wanted)[which].astype(np.int32)), pa.array(subsets[which, feature].astype(np.int32)),
            pa.array((cell % BINS).astype(np.int32)), *(pa.array(t[cell]) for t in total),
        ],
        names=["node", "feature", "bin", "n", "g", "h"],
    )


def dealt(cells: DataFrame, nodes: int, k: int) -> DataFrame:
    """Cells by node and feature, in tasks of a bounded number of cells; that number does not depend on the rows."""
    return cells.repartition(-(-nodes * k * BINS // MERGED), "node", "feature")


# --- gains --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BoostParams:
    """Second-order boosting. Depth-wise growth has no ``max_leaves``; with one, the leaf of the largest gain is split next."""

    rounds: int = 100
    learning_rate: float = 0.3
    max_depth: int = 6
    max_leaves: int | None = None
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    min_child_rows: int = 1
    subsample: float = 1.0
    colsample: float = 1.0
    average_start: bool = False
    max_bins: int = BINS
    seed: int = 42


def _score(g: str, h: str, reg_lambda: float) -> str:
    """G^2 / (H + lambda) of sums that are kept as integers; 0 where nothing is left to divide by."""
    g, h = f"(({g}) / {SCALE}D)", f"(({h}) / {SCALE}D + {reg_lambda}D)"
    return f"if({h} > 0, {g} * {g} / {h}, 0D)"


def split_gains(cells: DataFrame, p: BoostParams) -> DataFrame:
    """Every cut of every node: (node, feature, bin, nl, gl, hl, n, g, h, gain).

    gain = GL^2/(HL+lambda) + GR^2/(HR+lambda) - G^2/(H+lambda); null where a side is too small.
    """
    feature = "(PARTITION BY node, feature)"
    upto = "(PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    wide = cells.selectExpr(
        "node", "feature", "bin", *[f"sum({c}) OVER {upto} AS {c}l" for c in "ngh"], *[f"sum({c}) OVER {feature} AS {c}" for c in "ngh"],
    )
    rows, weight = max(p.min_child_rows, 1), f"{p.min_child_weight * SCALE}D"
    enough = f"nl >= {rows} AND n - nl >= {rows} AND hl >= {weight} AND h - hl >= {weight}"
    gain = f"{_score('gl', 'hl', p.reg_lambda)} + {_score('g - gl', 'h - hl', p.reg_lambda)} - {_score('g', 'h', p.reg_lambda)}"
    return wide.selectExpr("*", f"if({enough}, {gain}, NULL) AS gain")


def best_splits(gains: DataFrame) -> dict[int, dict]:
    """The best cut of each node; ties go to the smaller feature, then the smaller bin. One row a node."""
    best = "max(struct(gain, -feature AS f, -bin AS b, nl, gl, hl, n, g, h)) AS s"
    rows = gains.groupBy("node").agg(F.expr(best)).select("node", "s.*").collect()
    return {r["node"]: {**r.asDict(), "feature": -r["f"], "bin": -r["b"]} for r in rows}


def _merged(batches: Iterator[pa.RecordBatch]) -> pa.Table:
    """The cells of a task, equal ones added up whenever ``MERGED`` more have come."""
    keys, values = ["node", "feature", "bin"], ["n", "g", "h"]

    def added(tables: list[pa.Table]) -> pa.Table:
        total = pa.concat_tables(tables).group_by(keys).aggregate([(c, "sum") for c in values])
        return total.select([*keys, *(f"{c}_sum" for c in values)]).rename_columns([*keys, *values])

    held, waiting = [], 0
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        waiting += batch.num_rows
        if waiting >= MERGED:
            held, waiting = [added(held)], 0
    if not held:
        return pa.table({c: pa.array([], pa.int64()) for c in (*keys, *values)})
    return added(held).sort_by([(c, "ascending") for c in keys])


def best_cuts(cells: DataFrame, p: BoostParams, nodes: int, k: int) -> dict[int, dict]:
    """The best cut of each node, as ``split_gains`` and ``best_splits`` find it, in one job: a task adds up the cells of
    its features and returns a row per node."""
    rows, weight = max(p.min_child_rows, 1), p.min_child_weight * SCALE

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        g, h = g / SCALE, h / SCALE + p.reg_lambda
        return np.where(h > 0, g * g / np.where(h > 0, h, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, feature, at, *values = (c.to_numpy() for c in _merged(batches).columns)
        if not len(node):
            return
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])])
        length = np.diff(np.r_[first, len(node)])
        n, g, h = (np.repeat(np.add.reduceat(v, first), length) for v in values)
        upto = [np.cumsum(v) for v in values]
        nl, gl, hl = (u - np.repeat(u[first] - v[first], length) for u, v in zip(upto, values, strict=True))
        gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
        enough = (nl >= rows) & (n - nl >= rows) & (hl >= weight) & (h - hl >= weight)
        gain = np.where(enough, gain, -np.inf)
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        # The first of equals: cells are in the order of feature and bin.
        best = np.array([i + gain[i:j].argmax() for i, j in zip(start, np.r_[start[1:], len(node)], strict=True)])
        columns = [c[best] for c in (node, feature, at, nl, gl, hl, n, g, h)]
        none = ~enough[best]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c.astype(np.int64)) for c in columns), pa.array(gain[best], mask=none)],
            names=[c.split()[0] for c in BEST.split(", ")],
        )

    found: dict[int, dict] = {}
    rank = lambda s: (s["gain"] is not None, s["gain"] or 0.0, -s["feature"], -s["bin"])
    for s in dealt(cells, nodes, k).mapInArrow(run, BEST).toArrow().to_pylist():
        node = s["node"]
        if node not in found or rank(s) > rank(found[node]):
            found[node] = s
    return found


# --- boosting -----------------------------------------------------------------------------------------------------


def _chosen(best: dict[int, dict], children: dict[int, int], depth: dict[int, int], p: BoostParams) -> tuple[list[int], list[int]]:
    """(splits in best-first order, nodes to be split whose children are not counted yet).

    While the second list is not empty the first is a forecast: its nodes are split as far as known.
    """
    room = math.inf if p.max_leaves is None else p.max_leaves - 1
    splits, open_nodes, heap = [], [], []

    def push(node: int) -> None:
        gain = best[node]["gain"] if node in best else None
        if gain is not None and gain > LEAST_GAIN and depth[node] < p.max_depth:
            heapq.heappush(heap, (-gain, node))

    push(0)
    while heap and len(splits) + len(open_nodes) < room:
        node = heapq.heappop(heap)[1]
        if node in children:
            splits.append(node)
            push(children[node])
            push(children[node] + 1)
        else:
            open_nodes.append(node)
    return splits, open_nodes


def _finished(best: dict[int, dict], children: dict[int, int], splits: Sequence[int], cuts, p: BoostParams) -> Tree:
    """Prune splits under ``gamma`` from the leaves up, number what is left, set leaf values."""
    kept = set(splits)
    for node in sorted(kept, reverse=True):  # children have larger numbers
        below = (children[node], children[node] + 1)
        if not kept.intersection(below) and best[node]["gain"] < p.gamma:
            kept.discard(node)
    tree, order = Tree([], [], [], [], [], []), [0]
    for node in order:
        s = best.get(node)
        inner = node in kept
        g, h = (s["g"] / SCALE, s["h"] / SCALE + p.reg_lambda) if s else (0.0, 0.0)
        tree.feature.append(s["feature"] if inner else 0)
        tree.cut.append(s["bin"] if inner else 0)
        tree.threshold.append(cuts[s["feature"]][s["bin"]] if inner else 0.0)
        tree.left.append(len(order) if inner else -1)
        tree.value.append(-p.learning_rate * g / h if h > 0 else 0.0)
        tree.gain.append(s["gain"] if inner else 0.0)
        if inner:
            order += [children[node], children[node] + 1]
    return tree


def _gradients(trees: Sequence[Tree], at: tuple | None, p: BoostParams, number: int) -> Callable:
    """Rows of a batch with their node in the growing tree, gradient and curvature of the logistic loss."""

    def placed(batch: pa.RecordBatch, bins: np.ndarray):
        margin = batch.column("margin").to_numpy() + margins(bins, trees, "cut")
        share = 1 / (1 + np.exp(-margin))
        node = walk(bins, *at) if at else np.zeros(len(bins), dtype=np.int64)
        if p.subsample < 1:
            node = np.where(uniform(batch.column("row").to_numpy(), p.seed + number) < p.subsample, node, np.iinfo(np.int64).max)
        yield node, _whole(share - batch.column("y").to_numpy()), _whole(share * (1 - share))

    return placed


def _grow(table: DataFrame, since: Sequence[Tree], cuts, p: BoostParams, number: int) -> Tree:
    """One tree. A pass counts the children of all nodes that will be split as far as is known, so a tree takes
    about as many passes as it has levels, depth-wise and leaf-wise alike."""
    size = len(cuts)
    k = max(1, int(size * p.colsample))
    subset = np.sort(np.random.default_rng([p.seed, number]).choice(size, k, replace=False)) if k < size else np.arange(size)

    def counted(wanted: Sequence[int], at) -> dict[int, dict]:
        placed, subsets = _gradients(since, at, p, number), np.tile(subset, (len(wanted), 1))
        cells = table.mapInArrow(lambda batches: sums(batches, size, wanted, subsets, placed), CELL_SCHEMA)
        return best_cuts(cells, p, len(wanted), k)

    best = counted([0], None)
    children: dict[int, int] = {}
    depth, total = {0: 0}, 1
    while True:
        splits, open_nodes = _chosen(best, children, depth, p)
        if not open_nodes:
            break
        for node in open_nodes:
            children[node] = total
            depth[total] = depth[total + 1] = depth[node] + 1
            s = best[node]
            # Totals are known; a child that may be split gets its best cut below.
            best[total] = {"gain": None, "n": s["nl"], "g": s["gl"], "h": s["hl"]}
            best[total + 1] = {"gain": None, "n": s["n"] - s["nl"], "g": s["g"] - s["gl"], "h": s["h"] - s["hl"]}
            total += 2
        open_nodes = [n for n in open_nodes if depth[n] + 1 < p.max_depth]
        below = [children[n] + side for n in open_nodes for side in (0, 1)]
        group = max(1, CELLS // (k * BINS))
        feature, limit, left = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, -1)
        for node, child in children.items():
            feature[node], limit[node], left[node] = best[node]["feature"], best[node]["bin"], child
        for start in range(0, len(below), group):
            best |= counted(below[start : start + group], (feature, limit, left))
    return _finished(best, children, splits, cuts, p)


def root_gains(df: DataFrame, cuts: Sequence[Sequence[float]], params: BoostParams = BoostParams()) -> DataFrame:
    """Gains of all cuts before the first split (see ``split_gains``)."""
    cuts = _cuts(df, params.max_bins, cuts)
    size, subsets = len(cuts), np.arange(len(cuts))[None, :]
    placed = _gradients([], None, params, 0)
    cells = binned(df, cuts).mapInArrow(lambda batches: sums(batches, size, [0], subsets, placed), CELL_SCHEMA)
    merged = dealt(cells, 1, size).groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])
    return split_gains(merged, params).select("feature", "bin", "nl", "gl", "hl", "n", "g", "h", "gain")


def boost(df: DataFrame, params: BoostParams = BoostParams(), cuts: Sequence[Sequence[float]] | None = None) -> PipelineModel:
    """Boosted trees on (features, label in {0, 1}); ``cuts`` overrides the quantiles."""
    spark = df.sparkSession
    cuts = _cuts(df, params.max_bins, cuts)
    start = 0.0
    if params.average_start:
        share = df.where("label is not null").agg(F.avg("label")).first()[0] or 0.0
        start = math.log(share / (1 - share)) if 0 < share < 1 else 0.0
    table = binned(df, cuts, start)
    trees: list[Tree] = []
    since: list[Tree] = []
    for number in range(params.rounds if cuts else 0):
        if len(since) == STORE_EVERY:
            table, since = _stored(spark, table, since, len(cuts)), []
        tree = _grow(table, since, cuts, params, number)
        trees.append(tree)
        since.append(tree)
    release(spark, table)
    return _model(trees, "logistic", start, len(cuts))


def _cuts(df: DataFrame, max_bins: int, cuts):
    if not 2 <= max_bins <= BINS:
        raise ValueError(f"max_bins is {max_bins}; bins take one byte, so it lies from 2 to {BINS}")
    if cuts is None:
        first = df.select("features").first()
        return cut_points(df, first[0].size, max_bins) if first else []
    if any(len(c) >= BINS for c in cuts):
        raise ValueError(f"a feature has more than {BINS - 1} cuts")
    return [sorted(map(float, c)) for c in cuts]


def _stored(spark, table: DataFrame, since: Sequence[Tree], size: int) -> DataFrame:
    """The table with its margins brought up to date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = batch.column("margin").to_numpy() + margins(_bytes(batch.column("bins"), size), since, "cut")
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(now))

    new = materialise(table.mapInArrow(run, table.schema), "binned")
    release(spark, table)
    return new


def _model(trees: Sequence[Tree], link: str, start: float, size: int) -> PipelineModel:
    text = json.dumps([vars(t) for t in trees])
    return PipelineModel([TreeEnsemble(inputCol="features", outputCol="p", trees=text, link=link, start=start, size=size)])


# --- random trees -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class RandomParams:
    """Trees whose nodes draw one threshold per feature of a random subset and keep the best of these splits.

    With ``best`` a node compares all cuts of its features, as random forests do."""

    n_trees: int = 100
    max_depth: int = 30
    min_child_rows: int = 1
    max_features: str | float | int | None = "sqrt"
    bootstrap: bool = False
    max_bins: int = BINS
    seed: int = 42
    best: bool = False  # compare all cuts of the drawn features
    round_up: bool = False  # of a root, logarithm or share


def subset_size(rule: str | float | int | None, size: int, up: bool = False) -> int:
    """Features per node: all, a named root or logarithm, a share, or a number."""
    whole = math.ceil if up else int
    if rule is None:
        return size
    if rule in ("sqrt", "log2"):
        return max(1, whole(math.sqrt(size) if rule == "sqrt" else math.log2(size)))
    return max(1, min(size, whole(size * rule) if isinstance(rule, float) else int(rule)))


def draws(seed: int, tree: int, path: int, size: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of a node and where in their range the threshold lies; ``path`` is 1 at the root, and 2p and
    2p + 1 below p, so a node's draws depend on nothing else."""
    rng = np.random.default_rng([seed, tree, path])
    return rng.choice(size, k, replace=False), rng.random(k)


# Cumulative Poisson(1) probabilities: how often a row enters a bootstrap sample.
_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


def _impure(g: str, h: str) -> str:
    """Gini impurity of sums that are kept as integers, times their weight."""
    g, h = f"(({g}) / {SCALE}D)", f"(({h}) / {SCALE}D)"
    return f"if({h} > 0, 2 * {g} * ({h} - {g}) / {h}, 0D)"


def random_splits(cells: DataFrame, drawn: DataFrame, edges: DataFrame, least: int) -> dict[int, dict]:
    """The best drawn split of each node by the loss of Gini impurity: one row a node.

    ``drawn`` is (node, feature, u), ``edges`` (feature, cuts). A threshold lies at share u of the values that the
    node has, rounded to a cut between its lowest and its highest bin.
    """

    def left(c: str) -> str:
        return f"aggregate(bins, 0L, (a, b) -> if(b.bin <= bin, a + b.{c}, a)) AS {c}l"

    low, high = "if(lo > 0, cuts[lo - 1], cuts[0])", "if(hi < size(cuts), cuts[hi], cuts[size(cuts) - 1])"
    per = cells.groupBy("node", "feature").agg(
        *[F.expr(f"{f}(bin) AS {name}") for f, name in (("min", "lo"), ("max", "hi"))],
        *[F.expr(f"sum({c}) AS {c}") for c in "ngh"], F.expr("collect_list(struct(bin, n, g, h)) AS bins"),
    )
    place = f"size(filter(cuts, x -> x < {low} + u * ({high} - {low})))"
    at = f"if(lo < hi, greatest(lo, least(hi - 1, {place})), -1) AS bin"
    sides = per.join(drawn, ["node", "feature"]).join(edges, "feature").selectExpr("*", at).selectExpr("*", *[left(c) for c in "ngh"])
    gain = f"{_impure('g', 'h')} - {_impure('gl', 'hl')} - {_impure('g - gl', 'h - hl')}"
    return best_splits(sides.selectExpr(
        "node", "feature", "bin", "nl", "gl", "hl", "n", "g", "h", f"if(nl >= {least} AND n - nl >= {least}, {gain}, NULL) AS gain"
    ))


def best_random_splits(cells: DataFrame, least: int) -> dict[int, dict]:
    """The best of all cuts of each node by the loss of Gini impurity: one row a node."""
    feature = "(PARTITION BY node, feature)"
    upto = "(PARTITION BY node, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    wide = cells.selectExpr(
        "node", "feature", "bin", *[f"sum({c}) OVER {upto} AS {c}l" for c in "ngh"], *[f"sum({c}) OVER {feature} AS {c}" for c in "ngh"],
    )
    gain = f"{_impure('g', 'h')} - {_impure('gl', 'hl')} - {_impure('g - gl', 'h - hl')}"
    return best_splits(wide.selectExpr("*", f"if(nl >= {least} AND n - nl >= {least}, {gain}, NULL) AS gain"))


def _impurity(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``_impure`` on arrays of sums."""
    g, h = g / SCALE, h / SCALE
    return np.where(h > 0, 2 * g * (h - g) / np.where(h > 0, h, 1.0), 0.0)


def _cut_of_node(bins: np.ndarray, g: np.ndarray, h: np.ndarray, drawn: tuple[np.ndarray, np.ndarray], edges: Sequence[np.ndarray],
                 p: RandomParams) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split of a node, as ``random_splits`` and ``best_random_splits`` choose it."""
    order = np.argsort(drawn[0])
    features, u = drawn[0][order], drawn[1][order]
    x = bins[:, features]
    lo, hi = x.min(0), x.max(0)
    features, u, x, lo, hi = features[lo < hi], u[lo < hi], x[:, lo < hi], lo[lo < hi].astype(np.int64), hi[lo < hi].astype(np.int64)
    if not len(features):
        return None
    if p.best:
        width = int(hi.max()) + 1
        cell = (x + np.arange(len(features)) * width).ravel()
        n, gl, hl = (np.bincount(cell, v, len(features) * width).reshape(-1, width).cumsum(1) for v in (None, np.repeat(g, len(features)), np.repeat(h, len(features))))
        at = np.broadcast_to(np.arange(width), n.shape)
    else:
        at = np.empty(len(features), np.int64)
        for j, f in enumerate(features):
            cuts = edges[f]
            low, high = cuts[max(lo[j] - 1, 0)], cuts[min(hi[j], len(cuts) - 1)]
            at[j] = max(lo[j], min(hi[j] - 1, np.searchsorted(cuts, low + u[j] * (high - low))))
        left = x <= at
        n, gl, hl = left.sum(0), g @ left, h @ left
    total_g, total_h, least = g.sum(), h.sum(), max(p.min_child_rows, 1)
    gain = _impurity(total_g, total_h) - _impurity(gl, hl) - _impurity(total_g - gl, total_h - hl)
    gain = np.where((n >= least) & (len(g) - n >= least), gain, -1.0)
    best = np.unravel_index(gain.argmax(), gain.shape)  # the first of equals: smallest feature, then smallest bin
    return float(gain[best]), int(features[best[0]]), int(at[best])


def grown(bins: np.ndarray, g: np.ndarray, h: np.ndarray, tree: int, path: int, depth: int, edges: Sequence[np.ndarray], k: int,
          p: RandomParams) -> dict[str, np.ndarray]:
    """A node with all that grows below it, as arrays; its own place is 0."""
    nodes: list[tuple] = [(0, 0, -1, 0.0, 0.0)]
    todo = deque([(0, np.arange(len(g)), path, depth)])
    while todo:
        at, rows, path, depth = todo.popleft()
        own_g, own_h = g[rows], h[rows]
        total_g, total_h = int(own_g.sum()), int(own_h.sum())
        value = total_g / total_h if total_h else 0.5
        nodes[at] = (0, 0, -1, value, 0.0)
        if not (0 < total_g < total_h and len(rows) >= 2 * p.min_child_rows and depth < p.max_depth):
            continue
        own = bins[rows]
        found = _cut_of_node(own, own_g, own_h, draws(p.seed, tree, path, bins.shape[1], k), edges, p)
        if found is None or found[0] <= LEAST_GAIN:
            continue
        gain, feature, cut = found
        left = own[:, feature] <= cut
        nodes[at] = (feature, cut, len(nodes), value, gain)
        for side, part in enumerate((rows[left], rows[~left])):
            todo.append((len(nodes), part, 2 * path + side, depth + 1))
            nodes.append(())
    return {c: np.array(v, dtype=t) for (c, t), v in zip(PIECE.items(), zip(*nodes, strict=True), strict=True)}


def random_trees(df: DataFrame, params: RandomParams = RandomParams(), weight: Column | None = None,
                 cuts: Sequence[Sequence[float]] | None = None) -> PipelineModel:
    """Random trees on (features, label in {0, 1}); the score is the mean share of class 1 in the leaves.

    Nodes too large for one task grow a level at a time, all trees together: one aggregation a level, or several where
    the frontier does not fit ``CELLS``. A node of at most ``GROWN`` bytes of rows is grown to the end by the task that
    its rows are dealt to, and what grew is written as a row of the model's table; so the driver holds only the nodes
    above. ``weight`` lies in (0, 1]. A node whose drawn features are all constant becomes a leaf.
    """
    p, spark = params, df.sparkSession
    cuts = _cuts(df, p.max_bins, cuts)
    size = len(cuts)
    table = binned(df, cuts, weight=weight)
    k = subset_size(p.max_features, size, p.round_up) if size else 0
    edges = local_table(
        spark, {"feature": pa.array(range(size), pa.int32()), "cuts": pa.array([c or [0.0] for c in cuts], pa.list_(pa.float64()))}
    )
    rows, most = table.count(), max(1, GROWN // (size + 16))
    nodes = [{"tree": t, "path": 1, "depth": 0, "left": -1, "g": 0, "h": 0} for t in range(p.n_trees)]
    frontier = list(range(p.n_trees)) if size and rows else []
    whole, frontier = (frontier, []) if rows <= most else ([], frontier)
    group = max(1, CELLS // (max(k, 1) * BINS))
    while frontier:
        following: list[int] = []
        for start in range(0, len(frontier), group):
            wanted = frontier[start : start + group]
            found = _random_level(table, nodes, wanted, edges, size, k, p)
            for node in wanted:
                s = found.get(node)
                if s is None:
                    continue
                nodes[node] |= {"g": s["g"], "h": s["h"]}
                if s["gain"] is None or s["gain"] <= LEAST_GAIN:
                    continue
                nodes[node] |= {"left": len(nodes), "feature": s["feature"], "bin": s["bin"], "gain": s["gain"]}
                for side, (n, g, h) in enumerate(((s["nl"], s["gl"], s["hl"]), (s["n"] - s["nl"], s["g"] - s["gl"], s["h"] - s["hl"]))):
                    above = nodes[node]
                    if 0 < g < h and n >= 2 * p.min_child_rows and above["depth"] + 1 < p.max_depth:
                        (following if n > most else whole).append(len(nodes))
                    nodes.append({"tree": above["tree"], "path": 2 * above["path"] + side, "depth": above["depth"] + 1, "left": -1, "g": g, "h": h})
        frontier = following
    pieces = materialise(_pieces(table, nodes, whole, [np.asarray(c, dtype=np.float64) for c in cuts], k, p), "forest")
    release(spark, table)
    top = {c: [n.get("bin" if c == "cut" else c, 0) for n in nodes] for c in ("feature", "cut", "left", "tree", "gain")}
    top["value"] = [n["g"] / n["h"] if n["h"] else 0.5 for n in nodes]
    return PipelineModel([Forest.of(pieces, {"top": top, "cuts": cuts, "trees": p.n_trees, "per_tree": p.best})])


def _top(nodes: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array([n.get(c, 0) for n in nodes], dtype=np.int64) for c in ("feature", "bin", "left"))


def _placed(nodes: list[dict], roots: Sequence[int], p: RandomParams) -> Callable:
    """Rows of a batch with their node in each of the trees, gradient and weight."""
    feature, limit, left = _top(nodes)

    def placed(batch: pa.RecordBatch, bins: np.ndarray):
        y, w = batch.column("y").to_numpy(), batch.column("w").to_numpy()
        for root in roots:
            node, times = walk(bins, feature, limit, left, root), 1
            if p.bootstrap:
                times = np.searchsorted(_POISSON, uniform(batch.column("row").to_numpy(), p.seed + root), side="right")
                node = np.where(times > 0, node, np.iinfo(np.int64).max)
            yield node, _whole(w * times * y), _whole(w * times)

    return placed


def _pieces(table: DataFrame, nodes: list[dict], whole: Sequence[int], edges: Sequence[np.ndarray], k: int, p: RandomParams) -> DataFrame:
    """(node, arrays of what grew below it): the rows of each node meet in one task, which grows it to the end."""
    size = len(edges)
    placed = _placed(nodes, sorted({nodes[n]["tree"] for n in whole}), p)
    wanted, known = np.array(sorted(whole), dtype=np.int64), {n: tuple(nodes[n][c] for c in ("tree", "path", "depth")) for n in whole}

    def dealt_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _bytes(batch.column("bins"), size)
            for node, g, h in placed(batch, bins):
                order = np.argsort(node, kind="stable")
                ends = np.searchsorted(node[order], wanted, side="right")
                for n, first, end in zip(wanted.tolist(), np.searchsorted(node[order], wanted).tolist(), ends.tolist(), strict=True):
                    if first < end:
                        at = order[first:end]
                        row = [[n], [bins[at].tobytes()], [g[at].astype("<i8").tobytes()], [h[at].astype("<i8").tobytes()]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, t) for v, t in zip(row, (pa.int32(), *[pa.binary()] * 3), strict=True)], ["node", "bins", "g", "h"]
                        )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def piece() -> pa.RecordBatch:
            joined = [b"".join(column) for column in zip(*held, strict=True)]
            bins = np.frombuffer(joined[0], np.uint8).reshape(-1, size)
            out = grown(bins, np.frombuffer(joined[1], "<i8"), np.frombuffer(joined[2], "<i8"), *known[node], edges, k, p)
            return pa.RecordBatch.from_arrays(
                [pa.array([node], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in out.values())], ["node", *out]
            )

        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != node and held:
                    yield piece()
                    held.clear()
                node = own
                held.append(row)
        if held:
            yield piece()

    rows = table.mapInArrow(dealt_rows, "node int, bins binary, g binary, h binary")
    tasks = max(1, min(len(whole), MOST_TASKS))
    met = rows.repartition(tasks, "node").sortWithinPartitions("node")
    return met.mapInArrow(grow, "node int, " + ", ".join(f"{c} binary" for c in PIECE))


def _random_level(table: DataFrame, nodes: list[dict], wanted: Sequence[int], edges: DataFrame, size: int, k: int,
                  p: RandomParams) -> dict[int, dict]:
    pairs = [draws(p.seed, nodes[n]["tree"], nodes[n]["path"], size, k) for n in wanted]
    subsets = np.stack([f for f, _ in pairs])
    drawn = local_table(table.sparkSession, {
        "node": pa.array(np.repeat(wanted, k), pa.int32()), "feature": pa.array(subsets.ravel(), pa.int32()),
        "u": pa.array(np.concatenate([u for _, u in pairs])),
    })
    placed = _placed(nodes, sorted({nodes[n]["tree"] for n in wanted}), p)
    cells = table.mapInArrow(lambda batches: sums(batches, size, wanted, subsets, placed), CELL_SCHEMA)
    merged = dealt(cells, len(wanted), k).groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])
    least = max(p.min_child_rows, 1)
    return best_random_splits(merged, least) if p.best else random_splits(merged, drawn, edges, least)


# --- forests as models --------------------------------------------------------------------------------------------


class Forest(Transformer, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Mean share of class 1 in the leaves of many trees.

    The nodes that grew on the driver are a parameter, what grew below them a table with one row a node. To score, the
    table goes to the tasks in parts of at most ``PART`` bytes; the driver holds one part at a time.
    """

    head = Param(Params._dummy(), "head", "json of the upper nodes, cuts and number of trees", TypeConverters.toString)
    pieces: DataFrame | None = None
    _parts: list | None = None

    def __init__(self, head: str = "{}"):
        super().__init__()
        self._set(head=head, inputCol="features", outputCol="p")

    @classmethod
    def of(cls, pieces: DataFrame, head: dict) -> Forest:
        forest = cls(json.dumps(head))
        forest.pieces = pieces
        return forest

    def write(self) -> ForestWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> ForestReader:
        return ForestReader(cls)

    def release(self) -> None:
        """Delete the table of a forest that is not used any more."""
        for part in self._parts or []:
            part.destroy()
        release(self.pieces.sparkSession, self.pieces)

    def _head(self) -> dict:
        return json.loads(self.getOrDefault(self.head))

    def members(self) -> list[Tree]:
        """All trees, for tests and for small forests: they come to the driver."""
        head = self._head()
        top, cuts = head["top"], head["cuts"]
        below = {r["node"]: {c: np.frombuffer(r[c], t).tolist() for c, t in PIECE.items()} for r in self.pieces.collect()}
        trees = []
        for root in range(head["trees"]):
            tree, order = Tree([], [], [], [], [], []), [(None, root)]
            for source, at in order:
                if source is None and at in below:
                    source, at = below[at], 0
                own = source or top
                feature, cut, left = (own[c][at] for c in ("feature", "cut", "left"))
                inner = left >= 0
                tree.feature.append(feature if inner else 0)
                tree.cut.append(cut if inner else 0)
                tree.threshold.append(cuts[feature][cut] if inner else 0.0)
                tree.left.append(len(order) if inner else -1)
                tree.value.append(own["value"][at])
                tree.gain.append(own["gain"][at])
                if inner:
                    order += [(source, left), (source, left + 1)]
            trees.append(tree)
        return trees

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the summed gains of each feature's splits; each tree counts alike where all cuts were compared."""
        head = self._head()
        top, size = head["top"], len(head["cuts"])
        tree_of = dict(enumerate(top["tree"]))

        def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for node, feature, gain in zip(*(batch.column(c).to_pylist() for c in ("node", "feature", "gain")), strict=True):
                    found = np.bincount(np.frombuffer(feature, PIECE["feature"]), np.frombuffer(gain, PIECE["gain"]), size)
                    at = np.flatnonzero(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), tree_of[node])), pa.array(at), pa.array(found[at])], ["tree", "feature", "gain"]
                    )

        spark = self.pieces.sparkSession
        above = local_table(spark, {
            "tree": pa.array(top["tree"], pa.int64()), "feature": pa.array(top["feature"], pa.int64()),
            "gain": pa.array([float(g) for g in top["gain"]]),
        })
        rows = self.pieces.mapInArrow(gains, "tree bigint, feature bigint, gain double").unionByName(above)
        sums_ = rows.groupBy("tree", "feature").agg(F.sum("gain").alias("gain"))
        share = F.expr("try_divide(gain, sum(gain) OVER (PARTITION BY tree))") if head["per_tree"] else F.col("gain")
        total = np.zeros(size)
        for r in sums_.select("feature", share.alias("s")).groupBy("feature").agg(F.sum("s").alias("s")).collect():
            total[r["feature"]] = r["s"] or 0.0
        return DenseVector(total / (total.sum() or 1.0))

    def _broadcasts(self) -> list:
        """The table in parts, each as lists of (node, arrays)."""
        if self._parts is None:
            spark, parts, part, held = self.pieces.sparkSession, [], [], 0
            columns = ["node", *SCORED]
            sizes = self.pieces.select("node", sum((F.length(c) for c in SCORED), F.lit(0)).alias("n")).orderBy("node").collect()
            for r in sizes:
                if part and held + r["n"] > PART:
                    parts, part, held = [*parts, part], [], 0
                part, held = [*part, r["node"]], held + r["n"]
            self._parts = []
            for nodes in [*parts, part]:
                rows = self.pieces.where(F.col("node").between(nodes[0], nodes[-1])).select(columns).collect() if nodes else []
                self._parts.append(spark.sparkContext.broadcast([tuple(bytes(v) if i else v for i, v in enumerate(r)) for r in rows]))
        return self._parts

    def _transform(self, df: DataFrame) -> DataFrame:
        head, parts = self._head(), self._broadcasts()
        edges = [np.asarray(c, dtype=np.float64) for c in head["cuts"]]
        top, n_trees = head["top"], head["trees"]
        feature, limit, left = (np.array(top[c], dtype=np.int64) for c in ("feature", "cut", "left"))
        value, tree_of = np.array(top["value"]), top["tree"]

        @F.pandas_udf("double")
        def probability(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            if not edges:
                return pd.Series(np.full(len(x), 0.5))
            table = np.stack(x.to_numpy())
            bins = np.empty(table.shape, dtype=np.uint8)
            for f, edge in enumerate(edges):
                bins[:, f] = np.searchsorted(edge, table[:, f], side="left")
            ends = [walk(bins, feature, limit, left, root) for root in range(n_trees)]
            shares = np.stack([value[e] for e in ends])
            for part in parts:
                for node, *arrays in part.value:
                    f, c, below, own = (np.frombuffer(a, PIECE[name]) for name, a in zip(SCORED, arrays, strict=True))
                    at = np.flatnonzero(ends[tree_of[node]] == node)
                    shares[tree_of[node], at] = own[walk(bins[at], f, c, below)]
            total = np.zeros(len(x))
            for share in shares:
                total += share
            return pd.Series(total / max(n_trees, 1))

        return df.withColumn(self.getOutputCol(), probability(vector_to_array(self.getInputCol())))


class ForestWriter(MLWriter):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.forest, path, self.sparkSession)
        self.forest.pieces.write.mode("overwrite").parquet(f"{path}/pieces")


class ForestReader(MLReader):
    def __init__(self, cls: type[Forest]):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> Forest:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        forest = self.cls()
        forest._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(forest, metadata)
        forest.pieces = self.sparkSession.read.parquet(f"{path}/pieces")
        return forest
