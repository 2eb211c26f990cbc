"""Forests whose nodes are grown to the end in tasks."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector

from modlens.operators import models, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 40, size=(400, 4)).astype(float)
    y = ((x[:, 0] > 20) ^ (rng.random(400) < 0.3)).astype(float)
    rows = [(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    raw = spark.createDataFrame(rows, "doc_id bigint, x array<double>, label double")
    return x, y, raw.select("doc_id", array_to_vector("x").alias("features"), "label").repartition(3).cache()


@pytest.mark.parametrize("params", [trees.RandomParams(3), trees.RandomParams(2, bootstrap=True, max_bins=32, best=True, round_up=True)])
def test_nodes_grown_in_tasks_equal_nodes_grown_by_levels(data, params, monkeypatch, tmp_path):
    frame = data[2]
    model = trees.random_trees(frame, params)
    whole = model.stages[0].members()
    head = model.stages[0]._head()
    # The driver holds the roots and nothing of what grew below them.
    assert len(head["top"]["left"]) == params.n_trees and max(len(t.left) for t in whole) > 60
    monkeypatch.setattr(trees, "GROWN", 100 * 20)  # nodes of up to 100 rows
    monkeypatch.setattr(trees, "PART", 1000)
    levels = trees.random_trees(frame, params)
    assert len(levels.stages[0]._head()["top"]["left"]) > params.n_trees
    assert levels.stages[0].members() == whole
    scores = models.score(model, frame).orderBy("doc_id").collect()
    assert models.score(levels, frame).orderBy("doc_id").collect() == scores
    levels.write().overwrite().save(str(tmp_path / "m"))
    assert models.score(PipelineModel.load(str(tmp_path / "m")), frame).orderBy("doc_id").collect() == scores
    a, b = (m.stages[0].featureImportances.toArray() for m in (model, levels))
    assert a == pytest.approx(b) and a.argmax() == 0


def test_best_cuts_equal_a_plain_tree(data):
    """All features, no bootstrap: every node takes the cut of the largest gain, ties to the smaller feature and cut."""
    x, y, frame = data
    model = models.random_forest(frame, 1, 3, min_samples_leaf=5, max_features=None, bootstrap=False, max_bins=256)
    impure = lambda r: 2 * y[r].sum() * (len(r) - y[r].sum()) / len(r)
    want = np.empty(len(y))

    def grow(rows, depth):
        best = (1e-6, None)
        if 0 < y[rows].sum() < len(rows) and depth < 3:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[:-1]:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    gain = impure(rows) - impure(left) - impure(right)
                    if min(len(left), len(right)) >= 5 and gain > best[0] + 1e-12:
                        best = (gain, (left, right))
        if best[1] is None:
            want[rows] = y[rows].mean()
        else:
            for part in best[1]:
                grow(part, depth + 1)

    grow(np.arange(len(y)), 0)
    got = [r["p"] for r in models.score(model, frame).orderBy("doc_id").collect()]
    assert got == pytest.approx(want, abs=1e-9)
