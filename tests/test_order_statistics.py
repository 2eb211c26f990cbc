"""Ranks, splits and cumulative counts against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modlens.operators import evaluate, ranking, split


def brute_ranks(ids, seed):
    order = sorted(ids, key=lambda i: (hashlib.md5(f"{i}|{seed}".encode()).hexdigest(), i))
    return {i: r for r, i in enumerate(order, 1)}


def test_slices_match_ranks_for_a_hot_class(make):
    hot, small = list(range(500)), list(range(1000, 1007))
    df = make([(i, 0) for i in hot] + [(i, 1) for i in small], "doc_id bigint, y int")
    out = {r["doc_id"]: r["slice"] for r in ranking.rank_slices(df, "doc_id", 7, {"zero": lambda n: F.lit(0), "third": lambda n: F.ceil(n / 3)}, ["y"]).collect()}
    for ids in (hot, small):
        ranks = brute_ranks(ids, 7)
        cut = math.ceil(len(ids) / 3)
        assert {i: out[i] for i in ids} == {i: 1 + (ranks[i] > cut) for i in ids}


def test_empty_sample_and_whole_sample(make):
    df = make([(i, i % 2) for i in range(20)], "doc_id bigint, y int")
    assert split.stratified_sample(df, ["y"], 0.01).count() == 0
    assert split.stratified_sample(df, ["y"], 1.0).count() == 20


def test_folds_are_balanced_in_each_class(make):
    df = make([(i, int(i % 7 == 0)) for i in range(203)], "doc_id bigint, y int")
    counts = Counter((r["y"], r["fold"]) for r in split.add_folds(df, ["y"]).collect())
    for y in (0, 1):
        sizes = [counts[(y, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


def test_split_does_not_depend_on_partitioning(make):
    df = make([(i, i % 3) for i in range(300)], "doc_id bigint, y int")
    a = {r["doc_id"]: r["part"] for r in split.train_validation(df.repartition(3), ["y"]).collect()}
    b = {r["doc_id"]: r["part"] for r in split.train_validation(df.repartition(11), ["y"]).collect()}
    assert a == b and Counter(a.values())["validation"] == 60


def test_any_label_needs_a_toxicity_column(make):
    assert split.any_label(["doc_id", "insult"]) is None
    df = make([(1, 0, 1), (2, 0, 0), (3, 1, 0)], "doc_id bigint, toxic int, insult int")
    assert sorted(r["any_label"] for r in split.split_any_label(df).collect()) == [0, 1, 1]


@pytest.fixture(scope="module")
def scores(make):
    rng = random.Random(3)
    rows = []
    for m in ("a", "b"):
        for i in range(400):
            p = rng.choice([0.25, rng.random()]) if m == "a" else round(rng.random(), 1)
            rows.append((m, i, int(rng.random() < p), p))
    return rows, make(rows, "model string, doc_id bigint, label int, p double").cache()


def test_running_totals(scores):
    rows, df = scores
    out = ranking.running_totals(evaluate.score_counts(df), "model", "p", ["pos", "neg"], buckets=7).collect()
    for r in out:
        above = [x for x in rows if x[0] == r["model"] and x[3] >= r["p"]]
        assert r["pos_cum"] == sum(x[2] for x in above)
        assert r["neg_cum"] == sum(1 - x[2] for x in above)


def test_auc_counts_ties_half(scores):
    rows, df = scores
    auc = {r["model"]: r["roc_auc"] for r in evaluate.roc_auc(df).collect()}
    for m in ("a", "b"):
        pos = [x[3] for x in rows if x[0] == m and x[2]]
        neg = [x[3] for x in rows if x[0] == m and not x[2]]
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert auc[m] == pytest.approx(wins / len(pos) / len(neg))


def test_model_without_probabilities_has_no_auc(make):
    df = make([("m", 1, 1, None), ("m", 2, 0, None)], "model string, doc_id bigint, label int, p double")
    assert evaluate.roc_auc(df).first()["roc_auc"] is None


def test_best_threshold_is_the_lowest_on_ties(make):
    rows = [("m", 1, 1, 0.9), ("m", 2, 1, 0.8), ("m", 3, 0, 0.1), ("n", 1, 0, 0.5)]
    best = {r["model"]: r["threshold"] for r in evaluate.best_thresholds(make(rows, "model string, doc_id bigint, label int, p double")).collect()}
    assert best["m"] == 0.8
    assert best["n"] == 0.5


def test_sweep_has_every_threshold_and_first_optimum(scores):
    _, df = scores
    sweep = evaluate.threshold_sweep(df)
    assert sweep.count() == 24
    by_hand = {}
    for r in sorted(sweep.collect(), key=lambda r: r["threshold"]):
        best = by_hand.get(r["model"])
        if best is None or r["f1"] > best[0]:
            by_hand[r["model"]] = (r["f1"], r["threshold"])
    out = {r["model"]: r["best_f1_threshold"] for r in evaluate.sweep_optima(sweep).collect()}
    assert out == {m: t for m, (_, t) in by_hand.items()}


def test_preferred_model_wins_if_present(make):
    metrics = make([("a", 0.5), ("b", 0.9)], "model string, f1 double")
    assert evaluate.best_model(metrics).first()["model"] == "b"
    assert evaluate.best_model(metrics, "a").first()["model"] == "a"
    assert evaluate.best_model(metrics, "zzz").first()["model"] == "b"


def test_effective_threshold():
    assert evaluate.effective_threshold(0.2, 0.4) == 0.2
    assert evaluate.effective_threshold(None, 0.4) == 0.4
    assert evaluate.effective_threshold(None, None) == 0.5
    assert evaluate.effective_threshold(0.0, 0.4) == 0.0
