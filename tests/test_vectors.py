"""Neighbours, resampling, scaling and selection against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from modlens.operators import reduce as R
from modlens.operators import resample, select
from modlens.operators.knn import knn


@pytest.fixture(scope="module")
def cloud(make):
    rng = np.random.RandomState(1)
    x = np.vstack([rng.normal(size=(150, 3)), np.tile([[0.5, 0.5, 0.5]], (70, 1)), rng.normal(5, 1, (60, 3))])
    y = (np.arange(len(x)) % 9 == 0).astype(int)
    rows = [(int(i), [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, make(rows, "id bigint, x array<double>, y int").cache()


def brute(x, ids, pool, k):
    out = {}
    for i in ids:
        d = np.sqrt(((x[pool] - x[i]) ** 2).sum(axis=1))
        order = sorted((dist, int(j)) for dist, j in zip(d, pool, strict=True) if j != i)[:k]
        out[i] = [j for _, j in order]
    return out


@pytest.mark.parametrize("pivots,block", [(1, 4096), (12, 4096), (12, 7)])
def test_knn_is_exact_with_pruning_small_blocks_and_copies(cloud, pivots, block):
    x, y, df = cloud
    near = knn(df.filter("y = 1"), df, 4, pivots=pivots, block_rows=block).collect()
    out = {}
    for r in sorted(near, key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r["neighbour_id"])
    assert out == brute(x, [int(i) for i in np.flatnonzero(y)], np.arange(len(x)), 4)


def test_knn_with_fewer_candidates_than_k(make):
    df = make([(1, [0.0]), (2, [1.0])], "id bigint, x array<double>")
    assert {(r["query_id"], r["neighbour_id"]) for r in knn(df, df, 5).collect()} == {(1, 2), (2, 1)}


def test_smote_points_lie_between_two_minority_rows(cloud):
    x, y, df = cloud
    points = resample.smote_points(df).collect()
    assert len(points) == int((y == 0).sum() - (y == 1).sum())
    for p in points:
        a, b = x[p["seed_id"]], x[p["neighbour_id"]]
        assert y[p["seed_id"]] == y[p["neighbour_id"]] == 1 and 0 <= p["gap"] < 1
        assert np.allclose(p["x"], a + p["gap"] * (b - a))


def test_resampled_class_sizes(cloud):
    _, y, df = cloud
    majority, minority = int((y == 0).sum()), int((y == 1).sum())
    sizes = lambda d: tuple(r["n"] for r in d.groupBy("y").agg(F.count("*").alias("n")).orderBy("y").collect())
    assert sizes(resample.undersample(df, 1.0)) == (minority, minority)
    assert sizes(resample.undersample(df, 0.5)) == (2 * minority, minority)
    assert sizes(resample.smote(df)) == (majority, majority)
    kept = sizes(resample.smote_tomek(df))
    assert kept[0] == kept[1] <= majority  # a link removes one row of each class
    with pytest.raises(ValueError):
        resample.resample(df, "nope")


def test_scaler_keeps_constant_columns(make):
    df = make([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id bigint, x array<double>")
    out = sorted((r["id"], r["x"]) for r in R.Scaler.fit(df).transform(df).collect())
    assert out == [(1, [-1.0, 0.0]), (2, [1.0, 0.0])]


def test_pca_save_and_load(spark, cloud, tmp_path):
    model = R.PcaReducer.fit(cloud[2], 2)
    model.save(spark, str(tmp_path / "pca"))
    again = R.PcaReducer.load(spark, str(tmp_path / "pca"))
    assert np.allclose(again.components, model.components) and np.allclose(again.mean, model.mean)


def test_pca_matches_numpy(cloud):
    x, _, df = cloud
    model = R.PcaReducer.fit(df, 2)
    centred = x - x.mean(axis=0)
    _, s, _ = np.linalg.svd(centred, full_matrices=False)
    out = np.array([r["x"] for r in model.transform(df).orderBy("id").collect()])
    assert np.allclose((out**2).sum(axis=0), s[:2] ** 2)
    assert model.variance[0] >= model.variance[1]
    with pytest.raises(ValueError):
        R.reduce_dimensions(df, df, "nope")


def test_stop_rule():
    assert R.stop_at([(1, 0.5), (2, 0.7), (3, 0.7004), (4, 0.9)], 0.001) == 3
    assert R.stop_at([(1, 0.5), (2, 0.7)], 0.001) is None


@pytest.fixture(scope="module")
def wide(make):
    rng = np.random.RandomState(2)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] + 0.2 * rng.normal(size=200) > 0).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, make(rows, "doc_id bigint, a double, b double, c double, d double, y int").cache()


def test_elastic_net_meets_the_optimality_conditions(wide):
    x, y, _ = wide
    design = np.column_stack([np.ones(len(x)), x, y])
    alpha, rho = 0.05, 0.5
    beta, intercept = select.elastic_net(design.T @ design, alpha, rho, 1000, 1e-12)
    residual = y - intercept - x @ beta
    assert abs(residual.mean()) < 1e-9
    gradient = x.T @ residual / len(x) - alpha * (1 - rho) * beta
    for g, b in zip(gradient, beta, strict=True):
        assert abs(g) <= alpha * rho + 1e-7 if b == 0 else g == pytest.approx(alpha * rho * np.sign(b), abs=1e-6)


def test_fold_grams_and_selection(wide):
    x, y, df = wide
    result = select.elastic_net_selection(df, list("abcd"), "y", 0.05)
    assert "a" in result.selection.kept and len(result.selection.kept) < 4
    assert result.cv.count() == 20 and result.holdout_mse < 0.2
    assert result.selection.apply(df).columns == ["doc_id", *result.selection.kept, "y"]
    with pytest.raises(ValueError):
        select.elastic_net_selection(df, list("abcd"), "missing")


def test_gram_mse_matches_rows(wide):
    x, y, df = wide
    grams = select.fold_grams(df.withColumn("f", (F.col("doc_id") % 2).cast("int")), list("abcd"), "y", "f")
    beta = np.array([0.3, -0.1, 0.0, 0.2])
    half = np.arange(len(x)) % 2 == 1
    assert select.gram_mse(grams[1], beta, 0.4) == pytest.approx(np.mean((y[half] - 0.4 - x[half] @ beta) ** 2))


@pytest.mark.parametrize("method", ["chi2", "f_classif", "mutual_info", "model_based"])
def test_every_selector_keeps_the_signal(wide, method):
    _, _, df = wide
    shifted = df.select("doc_id", "y", *[(F.col(c) + 5).alias(c) for c in "abcd"])
    assert "a" in select.select_features(shifted, list("abcd"), "y", method, k=1).kept


def test_unknown_selector(wide):
    with pytest.raises(ValueError):
        select.select_features(wide[2], list("abcd"), "y", "nope")


def test_normality_verdicts(make):
    rng = np.random.RandomState(0)
    rows = [("normal", float(v)) for v in rng.normal(size=500)] + [("skewed", float(v)) for v in rng.exponential(size=500)]
    out = {r["feature"]: r["verdict"] for r in select.normality(make(rows, "feature string, value double")).collect()}
    assert out == {"normal": "normally distributed", "skewed": "NOT normally distributed"}


def test_density_integrates_to_one(wide):
    rows = select.class_densities(wide[2], ["a"], "y").orderBy("label", "at").collect()
    for label in (0, 1):
        part = [(r["at"], r["density"]) for r in rows if r["label"] == label]
        assert np.trapezoid([d for _, d in part], [a for a, _ in part]) == pytest.approx(1.0, abs=1e-2)


def test_pruning_drops_the_later_twin(make):
    rows = [(float(i), float(2 * i), float((i * 7) % 5)) for i in range(50)]
    assert select.prune_correlated(make(rows, "a double, b double, c double"), ["a", "b", "c"], 0.9) == ["a", "c"]
