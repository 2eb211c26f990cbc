from __future__ import annotations

import numpy as np
from pyspark.ml.recommendation import ALS

from modlens.operators import factors


def test_rows_of_few_and_many_entries_solve_the_same_equations():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    gram = x.astype(float).T @ x.astype(float)
    sizes = np.array([1, 2, 2, 39, 40, 41, 150])
    at = np.concatenate([rng.permutation(300)[:n] for n in sizes])
    c = rng.uniform(0.01, 9, size=sizes.sum())
    found = factors.solve_rows(x, at, c, sizes, gram)
    for row, places, w in zip(found, np.split(at, np.cumsum(sizes)[:-1]), np.split(c, np.cumsum(sizes)[:-1]), strict=True):
        y = x[places].astype(float)
        a = gram + y.T @ (w[:, None] * y) + 0.1 * len(w) * np.eye(12)
        assert np.allclose(row, np.linalg.solve(a, y.T @ (1 + w)), rtol=1e-8, atol=1e-10)


def test_item_factors_are_those_of_spark_als(make):
    """From the same start, sweep by sweep, also with entries that occur twice; before, Spark solved every row in full."""
    rng = np.random.default_rng(5)
    cells = {(int(u), int(i)) for u, i in zip(rng.integers(0, 90, 1500), rng.zipf(1.6, 1500) % 50, strict=True)}
    rows = [(u, i, float(rng.uniform(0.1, 4))) for u, i in sorted(cells)]
    ratings = make([*rows, rows[0]], "user int, item int, rating double")
    als = ALS(rank=6, maxIter=4, implicitPrefs=True, seed=42, userCol="user", itemCol="item", ratingCol="rating")
    want = {r["id"]: r["features"] for r in als.fit(ratings).itemFactors.collect()}
    got = {r["id"]: r["features"] for r in factors.item_factors(ratings, 6, 4, 42, blocks=3).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-3, atol=1e-4) for k in want)
