"""Histogram trees against plain numpy versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modlens.operators import models, trees
from modlens.operators.trees import SCALE, BoostParams


def table(spark, rows):
    raw = spark.createDataFrame(rows, "doc_id bigint, x array<double>, label double")
    return raw.select("doc_id", array_to_vector("x").alias("features"), "label")


def points(n=300, d=4, seed=3, levels=12):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, levels, size=(n, d)).astype(float)
    y = ((x[:, 0] > 5) ^ (x[:, 1] > 7) ^ (rng.random(n) < 0.1)).astype(float)
    return x, y


@pytest.fixture(scope="module")
def data(spark):
    x, y = points()
    rows = [(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, table(spark, rows).repartition(3).cache()


def plain_boost(x, y, p: BoostParams, start=0.0):
    """Margins of a booster that sorts every node's values; best-first if there is a leaf limit."""
    margin = np.full(len(y), start)
    leaf_counts = []

    def best(rows, g, h):
        found = (0.0, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        score = lambda a, b: a * a / (b + p.reg_lambda) if b + p.reg_lambda > 0 else 0.0
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                gl, hl = g[left].sum(), h[left].sum()
                if min(len(left), len(rows) - len(left)) < p.min_child_rows or min(hl, total_h - hl) < p.min_child_weight:
                    continue
                gain = score(gl, hl) + score(total_g - gl, total_h - hl) - score(total_g, total_h)
                if gain > max(found[0], 1e-6) + 1e-12:
                    found = (gain, (f, cut))
        return found

    for _ in range(p.rounds):
        share = 1 / (1 + np.exp(-margin))
        g, h = np.rint((share - y) * SCALE) / SCALE, np.rint(share * (1 - share) * SCALE) / SCALE
        nodes = [{"rows": np.arange(len(y)), "depth": 0, "kids": None, "split": best(np.arange(len(y)), g, h)}]
        leaves, limit = 1, p.max_leaves or 10**9
        while leaves < limit:
            able = [n for n in nodes if n["kids"] is None and n["depth"] < p.max_depth and n["split"][1]]
            if not able:
                break
            node = max(able, key=lambda n: n["split"][0])
            f, cut = node["split"][1]
            parts = [node["rows"][x[node["rows"], f] <= cut], node["rows"][x[node["rows"], f] > cut]]
            node["kids"] = [{"rows": r, "depth": node["depth"] + 1, "kids": None, "split": best(r, g, h)} for r in parts]
            nodes += node["kids"]
            leaves += 1
        for node in reversed(nodes):
            if node["kids"] and all(k["kids"] is None for k in node["kids"]) and node["split"][0] < p.gamma:
                node["kids"] = None
                node["pruned"] = True

        def add(node):
            if node["kids"]:
                return sum(add(k) for k in node["kids"])
            rows = node["rows"]
            margin[rows] -= p.learning_rate * g[rows].sum() / (h[rows].sum() + p.reg_lambda)
            return 1

        leaf_counts.append(add(nodes[0]))
    return margin, leaf_counts


@pytest.mark.parametrize(
    "params",
    [
        BoostParams(rounds=10, max_depth=3),
        BoostParams(rounds=3, max_depth=5, gamma=1.5, reg_lambda=0.5, min_child_weight=2.0),
        BoostParams(rounds=3, max_depth=8, max_leaves=7, reg_lambda=0.0, min_child_weight=1e-3, min_child_rows=10,
                    learning_rate=0.1, average_start=True),
    ],
)
def test_boosting_equals_a_plain_booster(data, params):
    x, y, frame = data
    start = float(np.log(y.mean() / (1 - y.mean()))) if params.average_start else 0.0
    want, leaves = plain_boost(x, y, params, start)
    model = trees.boost(frame, params)
    assert [sum(c < 0 for c in t.left) for t in model.stages[0].members()] == leaves
    got = np.array([r["p"] for r in models.score(model, frame).orderBy("doc_id").collect()])
    assert got == pytest.approx(1 / (1 + np.exp(-want)), abs=1e-6)


def test_small_frontiers_and_chunks_change_nothing(data, monkeypatch):
    frame = data[2]
    params = BoostParams(rounds=2, max_depth=4)
    whole = trees.boost(frame, params).stages[0].members()
    monkeypatch.setattr(trees, "CELLS", 1)
    monkeypatch.setattr(trees, "ENTRIES", 64)
    assert trees.boost(frame.repartition(7), params).stages[0].members() == whole


def test_leaf_wise_loss_is_not_above_level_wise(data):
    x, y, frame = data
    level = trees.boost(frame, BoostParams(rounds=1, max_depth=3, min_child_weight=0.0))
    leaves = sum(c < 0 for c in level.stages[0].members()[0].left)
    leaf = trees.boost(frame, BoostParams(rounds=1, max_depth=30, max_leaves=leaves, min_child_weight=0.0))
    gain = lambda m: sum(m.stages[0].members()[0].gain)
    assert sum(c < 0 for c in leaf.stages[0].members()[0].left) == leaves
    assert gain(leaf) >= gain(level) - 1e-9


def test_row_and_feature_samples(data):
    frame = data[2]
    model = trees.boost(frame, BoostParams(rounds=6, max_depth=2, subsample=0.5, colsample=0.5))
    for tree in model.stages[0].members():
        assert len({f for f, c in zip(tree.feature, tree.left, strict=True) if c >= 0}) <= 2
    again = trees.boost(frame, BoostParams(rounds=6, max_depth=2, subsample=0.5, colsample=0.5))
    assert models.score(model, frame).collect() == models.score(again, frame).collect()


def plain_random_trees(x, y, cuts, p):
    """Mean leaf shares of trees that take the same draws, row by row."""
    n, d = x.shape
    k = trees.subset_size(p.max_features, d)
    bins = np.column_stack([np.searchsorted(cuts[f], x[:, f]) for f in range(d)])
    impure = lambda r: 2 * y[r].sum() * (len(r) - y[r].sum()) / len(r)
    share = np.zeros(n)

    def grow(rows, tree, path, depth):
        best = (1e-6, None)
        if 0 < y[rows].sum() < len(rows) and depth < p.max_depth and len(rows) >= 2 * p.min_child_rows:
            for f, u in sorted(zip(*trees.draws(p.seed, tree, path, d, k), strict=True)):
                lo, hi = bins[rows, f].min(), bins[rows, f].max()
                if lo == hi:
                    continue
                low, high = cuts[f][max(lo - 1, 0)], cuts[f][min(hi, len(cuts[f]) - 1)]
                at = max(lo, min(hi - 1, np.searchsorted(cuts[f], low + u * (high - low))))
                left, right = rows[bins[rows, f] <= at], rows[bins[rows, f] > at]
                gain = impure(rows) - impure(left) - impure(right)
                if min(len(left), len(right)) >= p.min_child_rows and gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        if best[1] is None:
            share[rows] += y[rows].mean() / p.n_trees
        else:
            for side in (0, 1):
                grow(best[1][side], tree, 2 * path + side, depth + 1)

    for tree in range(p.n_trees):
        grow(np.arange(n), tree, 1, 0)
    return share


@pytest.mark.parametrize("params", [trees.RandomParams(5), trees.RandomParams(3, max_depth=4, min_child_rows=8, max_features=None)])
def test_random_trees_equal_a_plain_version(data, params, monkeypatch):
    x, y, frame = data
    cuts = trees.cut_points(frame, x.shape[1])
    want = plain_random_trees(x, y, cuts, params)
    monkeypatch.setattr(trees, "CELLS", 8192)  # several passes a level
    model = trees.random_trees(frame, params)
    got = np.array([r["p"] for r in models.score(model, frame).orderBy("doc_id").collect()])
    assert got == pytest.approx(want, abs=1e-9)


def test_thresholds_are_drawn_over_the_whole_range(data):
    frame = data[2]
    model = trees.random_trees(frame, trees.RandomParams(60, max_depth=1, max_features=None))
    drawn = {(t.feature[0], t.cut[0]) for t in model.stages[0].members()}
    assert len(drawn) > 8


def test_bootstrap_and_class_weights(data):
    x, y, frame = data
    weighted = models.extra_trees(frame, 8, max_depth=6, bootstrap=True, class_weight="balanced")
    roots = [t.value[0] for t in weighted.stages[0].members()]
    # Balanced weights bring the root's share near a half, and every sample differs.
    assert abs(np.mean(roots) - 0.5) < 0.06 and len(set(roots)) == 8


def test_edges(spark, tmp_path):
    nan = float("nan")
    rows = [(i, [nan if i % 2 else 1.0, 5.0], float(i % 2)) for i in range(40)]
    odd = table(spark, [*rows, (99, [1.0, 5.0], None)])
    model = trees.boost(odd, BoostParams(rounds=3))
    # Non-numbers lie right of every cut.
    scores = {r["doc_id"]: r["p"] for r in model.transform(odd).collect()}
    assert scores[1] > 0.6 and scores[0] < 0.4 and scores[99] == scores[0]
    assert model.stages[0].featureImportances.toArray().tolist() == [1.0, 0.0]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(odd)
    assert {r["doc_id"]: r["p"] for r in again.collect()} == scores
    flat = table(spark, [(i, [3.0], float(i < 2)) for i in range(8)])
    tree = trees.boost(flat, BoostParams(rounds=1)).stages[0].members()[0]
    assert tree.left == [-1] and tree.value[0] == pytest.approx(-0.3 * 2 / 3)  # G = 2, H + 1 = 3
    empty = trees.boost(flat.where("false"), BoostParams(rounds=2))
    assert {r["p"] for r in empty.transform(flat).collect()} == {0.5}
    bag = trees.random_trees(odd, trees.RandomParams(4, max_features=None))
    assert {r["doc_id"] % 2: r["p"] for r in bag.transform(odd).where("doc_id < 40").collect()} == {0: 0.0, 1: 1.0}
    assert {r["p"] for r in trees.random_trees(flat, trees.RandomParams(2)).transform(flat).collect()} == {0.25}
    assert {r["p"] for r in trees.random_trees(flat.where("false"), trees.RandomParams(2)).transform(flat).collect()} == {0.5}
    with pytest.raises(ValueError):
        trees.boost(flat, BoostParams(max_bins=300))


def test_many_distinct_values_become_quantiles(spark):
    df = spark.range(5000).select(
        array_to_vector(F.array(F.col("id").cast("double"))).alias("features"), (F.col("id") >= 2500).cast("double").alias("label")
    )
    cuts = trees.cut_points(df, 1)[0]
    assert len(cuts) == 255 and max(np.diff([-1.0, *cuts, 4999.0])) <= 22


def test_binned_rows_are_dealt_to_all_slots(spark, data):
    x, _, frame = data
    one = trees.binned(frame.coalesce(1), [sorted(set(c)) for c in x.T.tolist()])
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert one.select("row").distinct().count() == len(x)


@pytest.mark.parametrize("params", [BoostParams(), BoostParams(min_child_rows=9, min_child_weight=2.0, reg_lambda=0.0)])
def test_best_cuts_are_those_of_the_gains_in_sql(spark, params, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(int(node), int(f), int(b), int(n), int(rng.integers(-3, 4)) * SCALE, int(n) * SCALE // 4)
            for node in (1, 2, 7) for f in (0, 3, 4) for b in range(6) for n in rng.integers(1, 6, size=2)]
    rows += [(9, f, 2, 4, SCALE, SCALE) for f in (3, 4)]  # a single value: no cut
    rows += [(r[0], 5, *r[2:]) for r in rows if r[1] == 4]  # features 4 and 5 tie
    cells = spark.createDataFrame(rows, trees.CELL_SCHEMA).repartition(3)
    monkeypatch.setattr(trees, "MERGED", 64)
    merged = cells.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])
    want = trees.best_splits(trees.split_gains(merged, params))
    got = trees.best_cuts(cells, params, 4, 4)
    assert got.keys() == want.keys() == {1, 2, 7, 9} and want[9]["gain"] is None
    for node, s in want.items():
        assert got[node]["gain"] == s["gain"]
        assert s["gain"] is None or all(got[node][c] == s[c] for c in ("feature", "bin", "nl", "gl", "hl", "n", "g", "h"))
