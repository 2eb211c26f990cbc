from __future__ import annotations

import numpy as np
import pytest

from modlens.operators import knn


def plain(queries, matrix, query_ids, ids, k):
    out = []
    for i, (q, own) in enumerate(zip(queries, query_ids, strict=True)):
        d = np.sqrt(((matrix - q) ** 2).sum(axis=1))
        order = [j for j in np.argsort(d, kind="stable") if ids[j] != own and np.isfinite(d[j])][:k]
        out += [(i, int(j)) for j in order]
    return sorted(out)


@pytest.mark.parametrize("shift", [0.0, 1e6, 1e200])
def test_nearest_rows_with_copies_ties_and_far_origin(shift):
    rng = np.random.default_rng(1)
    matrix = rng.integers(0, 3, size=(400, 6)).astype(float) + shift
    ids = np.arange(400) // 2 * 2
    row, at, dist = knn.nearest_rows(matrix[:50], matrix, ids[:50], ids, 7)
    assert sorted(zip(row.tolist(), at.tolist(), strict=True)) == plain(matrix[:50], matrix, ids[:50], ids, 7)
    delta = matrix[at] - matrix[row]
    assert np.array_equal(dist, np.sqrt(np.einsum("ij,ij->i", delta, delta)))


def test_nearest_rows_of_named_rows_and_broken_values():
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(30, 3))
    matrix[4, 1], matrix[9, 0] = np.nan, np.inf
    names = np.array([f"r{i:02}" for i in range(30)], dtype=object)
    for n in (30, 5, 3):
        keep = np.r_[0:4, 5:9, 10:30][:n] if n != 30 else np.r_[0:4, 5:9, 10:30]
        got = knn.nearest_rows(matrix[keep], matrix[keep], names[keep], names[keep], 4)
        assert sorted(zip(*(x.tolist() for x in got[:2]), strict=True)) == plain(matrix[keep], matrix[keep], names[keep], names[keep], 4)
    row, at, _ = knn.nearest_rows(matrix[:4], matrix, names[:4], names, 4)
    assert len(row) <= 16 and 9 not in at


def test_plain_differences_are_left_to_few_rows(monkeypatch):
    """Before, every pair of rows got its differences."""
    rng = np.random.default_rng(4)
    matrix, seen, stacked = rng.normal(size=(3000, 64)), [], np.einsum
    monkeypatch.setattr(knn.np, "einsum", lambda s, a, b: seen.append(len(a)) or stacked(s, a, b))
    knn.nearest_rows(matrix[:500], matrix, np.arange(500), np.arange(3000), 5)
    assert sum(seen) < 500 * 5 + 3500 + 1000


def test_resampling_methods_leave_only_their_sizes(spark, sf_dir):
    """Each method has ended, and its shuffles are gone, before the next one starts."""
    from modlens.plans import catalog

    found = catalog.resampled_sizes(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and {r["method"] for r in found.collect()} == set(catalog.resample.METHODS)
