"""Fitted families, pipelines and ensembles saved and loaded again, in batch and stream."""

from __future__ import annotations

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modlens.functions.text import CleanOptions
from modlens.operators import combine, embed, ensemble, models
from modlens.operators.topics import TopicParams
from modlens.operators.vectorize import TfidfParams
from modlens.sources.tables import ModelRegistry
from modlens.streaming import scoring

CONFIG = combine.FeatureConfig(
    tfidf=TfidfParams(20, 1, 1.0, (1, 2)), word2vec=embed.Word2VecParams(4, max_iter=1), doc2vec=embed.FactorParams(3, 1, 2),
    fasttext=embed.SubwordParams(4, buckets=50, min_gram=3, max_gram=3), topic=TopicParams(2, 20, 2), clean=CleanOptions(stemming=True),
)
TEXTS = [
    "You stupid idiots, go away!", "A kind word for kind people.", "Running dogs ran 12 times.", None, "", "!!! ???",
    "Nobody likes a stupid word.", "People are kind; dogs are kind.", "ÉTÉ 日本", "word " * 300,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


@pytest.fixture(scope="module")
def fitted(docs):
    return combine.FeatureExtractor(CONFIG).fit(docs)


def vectors(df):
    return {r["doc_id"]: r["v"] for r in df.select("doc_id", vector_to_array("features").alias("v")).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert b[k] == pytest.approx(a[k], abs=1e-6)


def test_config_as_json():
    assert combine.config_of_json(combine.config_json(CONFIG)) == CONFIG


def test_every_family_comes_back(spark, docs, fitted, tmp_path):
    fitted.save(str(tmp_path / "model"))
    loaded = combine.FeatureModel.load(spark, str(tmp_path / "model"))
    assert list(loaded.families) == list(fitted.families) == list(CONFIG.include)
    assert loaded.config == fitted.config and loaded.names() == fitted.names()
    same(vectors(fitted.transform(docs)), vectors(loaded.transform(docs)))


def test_pipeline_with_classifier_in_batch_and_stream(spark, docs, fitted, tmp_path):
    part = ("tfidf", "word2vec", "pos", "sentiment", "topic")
    fitted = combine.FeatureModel(CONFIG, {name: fitted.families[name] for name in part})
    labelled = fitted.transform(docs).withColumn("label", (F.col("doc_id") % 2).cast("double"))
    pipeline = combine.scoring_pipeline(fitted, models.logistic(labelled, max_iter=20))
    pipeline.write().overwrite().save(str(tmp_path / "p"))
    loaded = PipelineModel.load(str(tmp_path / "p"))
    direct = {r["doc_id"]: r["p"] for r in models.score(pipeline, docs).collect()}
    assert {r["doc_id"]: r["p"] for r in models.score(loaded, docs).collect()} == pytest.approx(direct, abs=1e-6)
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = scoring.read_documents(spark, str(tmp_path / "in"), docs.schema, files_per_trigger=1)
    scoring.start_pipeline_scoring(stream, loaded, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    streamed = {r["doc_id"]: r["p"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert streamed == pytest.approx(direct, abs=1e-6)


def test_own_family_without_a_stage_is_not_saved(docs):
    extractor = combine.FeatureExtractor(CONFIG)
    own = combine.Fitted(["n"], 1, lambda new, i, keep: new.select(i, F.length(combine.RAW).alias("n")))
    extractor.register("own", combine.Family(lambda df, i: own))
    model = extractor.fit(docs, include=["lexical", "own"])
    with pytest.raises(ValueError, match="own"):
        model.pipeline()


def test_ensembles_and_reports(spark, docs, tmp_path):
    rows = docs.select(
        "doc_id", F.array_join(F.array(F.lit("x")), "").alias("t"), (F.col("doc_id") % 2).cast("double").alias("label"),
        F.length(F.coalesce("text", F.lit(""))).cast("double").alias("n"), (F.col("doc_id") * 1.5).alias("m"),
    )
    rows = models.assemble(rows, ["n", "m"], "label")
    stack = ensemble.stack(rows, {"logistic": models.logistic, "forest": lambda df: models.random_forest(df, 3, 2)}, folds=2)
    ensembles = {
        "stacking": stack, "voting": ensemble.Voting(stack.members),
        "weighted_voting": ensemble.Voting(stack.members, {"logistic": 3.0, "forest": 1.0}),
    }
    registry = ModelRegistry(spark, str(tmp_path / "r"))
    metrics = spark.createDataFrame([("logistic", 0.5)], "model string, f1 double")
    registry.save(stack.members, metrics, ensembles, {"metrics_copy": metrics})
    loaded, stored = registry.load()
    assert set(loaded) == {"logistic", "forest"} and stored.collect() == metrics.collect()
    again = registry.load_ensembles(loaded)
    assert set(again) == set(ensembles)
    for name, e in ensembles.items():
        expected = {r["doc_id"]: r["p"] for r in e.score(rows).collect()}
        assert {r["doc_id"]: r["p"] for r in again[name].score(rows).collect()} == pytest.approx(expected)
    assert registry.report("metrics_copy").collect() == metrics.collect()
    with pytest.raises(FileNotFoundError):
        registry.report("other")
