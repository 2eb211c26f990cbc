"""Block-wise skip-gram: pairs, gradients, neighbours, and no vocabulary on the driver."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array

from modlens.operators import skipgram as sg


def test_pairs_lie_in_the_window():
    params = sg.SkipGramParams(window=3)
    hashes = np.arange(100, 140)
    words, others = sg.pairs_of(hashes, {}, params)
    gap = np.abs(words - others)
    assert gap.min() == 1 and gap.max() == 3
    # a word's window reaches equally far to both sides
    for w in range(104, 136):
        own = others[words == w] - w
        assert sorted(own[own < 0] * -1) == sorted(own[own > 0]) == list(range(1, own.max() + 1))
    assert all(len(x) == 0 for x in sg.pairs_of(hashes[:1], {}, params))
    assert len(sg.pairs_of(hashes, {h: 0.0 for h in range(100, 140)}, params)[0]) == 0


def test_update_follows_the_gradient(monkeypatch):
    """With a tiny rate, an update is the rate times the gradient of the pairs' objective, by differences."""
    monkeypatch.setattr(sg, "SHARED", 6)
    params = sg.SkipGramParams(vector_size=3, negatives=6)
    start = np.random.default_rng(1)
    vectors, context = start.normal(size=(40, 3)), start.normal(size=(5, 3))
    words, others, counts = np.array([0, 1, 2, 0]), np.array([1, 2, 2, 3]), np.ones(5, dtype=np.int64)
    draw = np.random.default_rng(5)
    order = draw.permutation(4)
    chance = np.cumsum(counts**0.75)
    negative = np.searchsorted(chance, draw.random(6) * chance[-1], side="right")

    def objective(v, c):
        log_sigmoid = lambda x: -np.log1p(np.exp(-x))
        return sum(log_sigmoid(v[w] @ c[o]) + sum(log_sigmoid(-v[w] @ c[k]) for k in negative if k != o)
                   for w, o in zip(words[order], others[order], strict=True))

    v, c = vectors.copy(), context.copy()
    sg.train(v, c, counts, words, others, 1e-6, np.random.default_rng(5), params)
    for moved, table, i in ((v, 0, (0, 1)), (v, 0, (2, 0)), (c, 1, (2, 2)), (c, 1, (4, 0)), (c, 1, (3, 1))):
        tables = [vectors.copy(), context.copy()]
        tables[table][i] += 1e-5
        slope = (objective(*tables) - objective(vectors, context)) / 1e-5
        assert (moved[i] - (vectors, context)[table][i]) / 1e-6 == pytest.approx(slope, rel=1e-2, abs=1e-3)


@pytest.fixture(scope="module")
def corpus(spark):
    """Two kinds of sentences; words of a kind occur together. One word stands in most sentences."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        kind = "ab"[i % 2]
        rows.append((i, ["hot"] * (i % 10 > 0) + [f"{kind}{rng.randrange(12)}" for _ in range(10)]))
    rows += [(600, []), (601, None), (602, ["alone"])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def nearest(vectors):
    """Share of words whose nearest other word is of their kind."""
    names = [w for w in vectors if w[0] in "ab" and w[1:].isdigit()]
    x = np.array([vectors[w] for w in names])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T - 2 * np.eye(len(x))
    return np.mean([names[i][0] == names[j][0] for i, j in enumerate(near.argmax(1))])


def test_neighbours_as_with_the_single_machine_trainer(corpus):
    params = sg.SkipGramParams(vector_size=16, window=4, epochs=12, learning_rate=0.05, blocks=3)
    rows = sg.skip_gram(corpus, "tokens", params).withColumn("v", vector_to_array("vector")).collect()
    vectors = {r["word"]: r["v"] for r in rows}
    assert set(vectors) == {*(f"{k}{i}" for k in "ab" for i in range(12)), "hot", "alone"}
    assert all(np.isfinite(v).all() and len(v) == 16 for v in vectors.values())
    plain = Word2Vec(vectorSize=16, windowSize=4, minCount=1, maxIter=12, seed=1, inputCol="tokens", outputCol="o")
    model = plain.fit(corpus.where("tokens is not null")).getVectors().withColumn("v", vector_to_array("vector"))
    spark_share = nearest({r["word"]: r["v"] for r in model.collect()})
    assert nearest(vectors) >= max(0.9, spark_share - 0.1)


def test_same_vectors_again(corpus):
    params = sg.SkipGramParams(vector_size=4, epochs=1, min_count=2, blocks=2)
    once, again = ({r["word"]: r["vector"] for r in sg.skip_gram(corpus, "tokens", params).collect()} for _ in range(2))
    assert once == again and "alone" not in once


def test_blocks_follow_the_vocabulary(spark):
    assert sg.n_blocks(0, 8) == 1 and sg.n_blocks(10**5, 8) == 7 and sg.n_blocks(10**6, 8) == 31
    assert sg.n_blocks(10**9, 1000) == -(-(10**9) // sg.MOST_WORDS)
    none = spark.createDataFrame([], "tokens array<string>")
    assert sg.skip_gram(none, "tokens", sg.SkipGramParams(4)).collect() == []


def test_blocks_are_gathered_and_steps_read_their_own_pairs(spark, corpus):
    # An epoch moves all vectors once per block: no more blocks than slots, unless a task would hold too much.
    assert sg.gathered(31, 8) == 8 and sg.gathered(7, 8) == 7 and sg.gathered(1, 8) == 1 and sg.gathered(800, 8) == 100
    pairs = sg._stored_pairs(sg._pair_groups(corpus, "tokens", {}, 3, sg.SkipGramParams()))
    files = [set(pairs.where(f"step = {s}").inputFiles()) for s in range(3)]
    read = [pairs.where(f"step = {s}")._jdf.queryExecution().executedPlan().toString() for s in range(3)]
    assert all("PartitionFilters: [isnotnull(step" in plan for plan in read) and files
    assert pairs.select("step").distinct().count() == 3
    tasks = spark.createDataFrame([(k,) for k in sg.spread_keys(spark, 8)], "k int").repartition(8, "k")
    assert sorted(len(p) for p in tasks.rdd.glom().collect()) == [1] * 8


def test_repeated_places_are_summed():
    rng = np.random.default_rng(2)
    table, at, rows = rng.normal(size=(9, 3)), np.array([4, 1, 4, 7, 4, 1, 0]), rng.normal(size=(7, 3))
    want = table.copy()
    np.add.at(want, at, rows)
    sg._add(table, at, rows)
    assert table == pytest.approx(want)


def test_a_word_that_fills_updates_does_not_overshoot():
    """Its summed steps are bounded; without a bound its vector grows by more each time until nothing is finite."""
    params, rng = sg.SkipGramParams(vector_size=20), np.random.default_rng(1)
    vectors = ((rng.random((4096, 20)) - 0.5) / 20).astype("f4")
    context, counts = np.zeros_like(vectors), np.ones(4096, np.int64)
    counts[:2] = 4096
    for k in range(30):
        words, others, hot = rng.integers(0, 4096, 8192), rng.integers(0, 4096, 8192), rng.random(8192) < 0.7
        words[hot], others[~hot] = k % 2, k % 2
        sg.train(vectors, context, counts, words, others, 0.025, rng, params)
    assert np.abs(vectors).max() < 100 and np.abs(context).max() < 100


def test_training_leaves_one_table_of_blocks(spark, corpus, monkeypatch):
    """Shuffles, pairs and copies of the documents go as soon as nothing reads them again."""
    dropped, release = [], sg.release
    monkeypatch.setattr(sg, "release", lambda spark, df: (dropped.append(tuple(df.columns)), release(spark, df)))
    sg.skip_gram(corpus, "tokens", sg.SkipGramParams(4, epochs=1, blocks=2)).count()
    assert ("tokens",) in dropped and any("others" in columns for columns in dropped)
