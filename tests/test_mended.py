"""Paths that used to depend on size: every one gives the same rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modlens.operators import embed, models, reduce, sentiment, vectorize
from modlens.sources import tables
from modlens.streaming import scoring

TEXTS = ["the very table is good", "a REALLY plain text", "not GOOD but bad!", "never so awful", "", None, "very very"]


def test_sentiment_does_not_depend_on_the_lexicon_size(make, monkeypatch):
    df = make([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    as_literal = sorted(tuple(r) for r in sentiment.sentiment_features(df).collect())
    monkeypatch.setattr(sentiment, "LITERAL_WORDS", 0)
    assert sorted(tuple(r) for r in sentiment.sentiment_features(df).collect()) == as_literal
    scores = {r[0]: r[4] for r in as_literal}
    assert scores[1] == 0.0 and scores[6] == 0.0 and scores[0] > 0


@pytest.mark.parametrize("folder", [True, False])
def test_stream_reads_files_and_folders(spark, sf_dir, tmp_path, folder):
    path = f"{sf_dir}/documents.parquet"
    if folder:
        spark.read.parquet(path).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        path = f"{tmp_path}/documents.parquet"
    stream = scoring.read_documents(spark, path, spark.read.parquet(path).schema)
    query = stream.select("doc_id").writeStream.format("memory").queryName(f"read_{folder}").trigger(availableNow=True)
    query.start().awaitTermination()
    assert spark.table(f"read_{folder}").distinct().count() == spark.read.parquet(path).count() > 0


def test_counts_in_the_row(make):
    terms = make([(1, ["b", "a", "b"]), (2, []), (3, ["c"]), (3, ["c"])], "doc_id long, terms array<string>")
    rows = sorted(tuple(r) for r in vectorize.bag_of_words(terms).collect())
    assert rows == [(1, "a", 1), (1, "b", 2), (3, "c", 1), (3, "c", 1)]
    plan = vectorize.bag_of_words(terms)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {tuple(r) for r in vectorize.document_frequency(terms).collect()} == {("a", 1, 1), ("b", 1, 2), ("c", 2, 2)}


def test_vocabulary_without_a_cap(make):
    terms = make([(1, ["b", "a", "b"]), (2, ["a", "d"]), (3, ["c", "a"])], "doc_id long, terms array<string>")
    params = vectorize.TfidfParams(None, 1, 1.0, (1, 1))
    capped = vectorize.TfidfParams(100, 1, 1.0, (1, 1))
    rows = [sorted(tuple(r) for r in vectorize.vocabulary(terms, p).collect()) for p in (params, capped)]
    assert rows[0] == rows[1] and [r[3] for r in rows[0]] == [0, 1, 2, 3]


def test_documents_have_numbers_of_their_own(make):
    rows = make([(i * 2**32,) for i in range(50)], "doc_id long").repartition(7)
    assert sorted(r["n"] for r in tables.numbered(rows, "n").collect()) == list(range(50))


def test_factor_embedding_uses_every_term(make):
    docs = make([(i, [f"w{i % 5}", f"w{(i + 1) % 5}", "x"]) for i in range(20)], "doc_id long, tokens array<string>")
    model = embed.FactorEmbedding.fit(docs, "tokens", embed.FactorParams(3, 1, 12))
    assert {r["word"] for r in model.terms.select("word").collect()} == {f"w{k}" for k in range(5)}


def test_wide_projection(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 400))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    axes = np.linalg.qr(rng.normal(size=(400, 100)))[0]
    reducer = reduce.PcaReducer(x.mean(0), axes, np.ones(100))
    got = np.array([r["x"] for r in reducer.transform(df).orderBy("id").collect()])
    assert np.allclose(got, (x - x.mean(0)) @ axes)
    scaled = reduce.Scaler(x.mean(0), x.std(0)).transform(df)
    assert np.allclose(np.array([r["x"] for r in scaled.orderBy("id").collect()]).std(0), 1)


def test_boosting_stores_its_weights(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    y = ((x[:, 0] + x[:, 1] + x[:, 2]) > 0).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, y.tolist(), strict=True))], "doc_id long, v array<double>, label double")
    df = df.select("doc_id", array_to_vector(F.col("v")).alias("features"), "label")
    rules = []
    for every in (3, 1000):
        monkeypatch.setattr(models, "STORE_EVERY", every)
        stumps = models.adaboost(df, 10).stages[-1]
        rules.append(np.array(__import__("json").loads(stumps.getOrDefault(stumps.rules))))
    assert len(rules[0]) == 10 and np.allclose(*rules)


def test_release_deletes_scratch_tables(spark, make):
    df = tables.materialise(make([(1,)], "a long"), "gone")
    folder = df.inputFiles()[0].rpartition("/")[0]
    tables.release(spark, df)
    assert not tables.path_exists(spark, folder)


def test_registered_queries_use_the_reference_parameters(monkeypatch):
    """Nothing is fitted: the calls are caught. Dimensions, epochs, topics and terms as in the reference."""
    from modlens.operators import embed, topics
    from modlens.plans import catalog

    seen = {}
    monkeypatch.setattr(catalog, "_token_docs", lambda spark, d: None)
    monkeypatch.setattr(catalog, "clean_table", lambda spark, d: None)
    for kind in (embed.WordEmbedding, embed.FactorEmbedding, embed.SubwordEmbedding, topics.TopicModel):
        model = type("Model", (), {"transform": lambda *a: None})()
        monkeypatch.setattr(kind, "fit", lambda docs, col, params, kind=kind, model=model: seen.update({kind: params}) or model)
    for name in ("word2vec_docs", "als_doc_embeddings", "subword_embeddings", "lda_topics"):
        catalog.QUERIES[name](None, "")
    word, factor, subword, topic = seen.values()
    assert (word.vector_size, word.window, word.min_count) == (100, 5, 1)
    assert (factor.vector_size, factor.min_count, factor.epochs) == (100, 2, 40)
    assert (subword.vector_size, subword.min_gram, subword.max_gram) == (100, 3, 6)
    assert (topic.n_topics, topic.max_features, topic.max_iter) == (10, 5000, 10)
