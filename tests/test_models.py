"""Models, search, ensembles, persistence and whole jobs."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from modlens.operators import combine, embed, ensemble, models, search, vectorize
from modlens.operators.topics import TopicModel, TopicParams
from modlens.plans import training
from modlens.sources.tables import CommentData, FeatureStore, ModelRegistry, with_target


@pytest.fixture(scope="module")
def rows(make):
    rng = np.random.RandomState(4)
    x = rng.normal(size=(160, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0.6).astype(int)
    data = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    wide = make(data, "doc_id bigint, a double, b double, c double, y int")
    return models.assemble(wide, ["a", "b", "c"], "y").coalesce(1).cache()


def accuracy(scored):
    return scored.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("label")).cast("double"))).first()[0]


@pytest.mark.parametrize(
    "fit",
    [
        partial(models.logistic, max_iter=50),
        partial(models.linear_svm, max_iter=20),
        partial(models.kernel_svm, dimension=32, max_iter=10),
        partial(models.extra_trees, n_estimators=5, max_depth=4),
        partial(models.lgbm_style, n_estimators=3, max_depth=3, min_child_samples=2),
        partial(models.adaboost, n_estimators=4),
    ],
)
def test_model_learns_and_survives_saving(rows, fit, tmp_path):
    model = fit(rows)
    scored = models.score(model, rows)
    assert accuracy(scored) > 0.8
    model.write().overwrite().save(str(tmp_path / "m"))
    again = models.score(PipelineModel.load(str(tmp_path / "m")), rows)
    key = lambda df: {r["doc_id"]: round(r["p"], 9) for r in df.collect()}
    assert key(scored) == key(again)


def test_adaboost_weights_the_first_stump(rows):
    import json

    stump = json.loads(models.adaboost(rows, 1).stages[0].getOrDefault("rules"))[0]
    data = [(r["features"], r["label"]) for r in rows.collect()]
    wrong = np.mean([(stump[2] if f[stump[0]] <= stump[1] else stump[3]) != y for f, y in data])
    assert stump[4] == pytest.approx(math.log((1 - wrong) / wrong))


def test_balanced_weights(make):
    df = make([(i, int(i < 2)) for i in range(10)], "doc_id bigint, label int")
    assert models.class_weights(df) == {1: 2.5, 0: 0.625}


def test_halving_schedule_matches_the_published_rungs():
    full = search.halving_schedule(60_000)
    assert [(r.rows, r.candidates) for r in full] == [(1500, 33), (4500, 11), (13500, 4), (40500, 2)]
    assert [(r.rows, r.candidates) for r in search.halving_schedule(300)] == [(100, 3), (300, 1)]


def test_candidates_are_seeded_and_inside_their_space():
    space = search.SPACES["gradient_boosting"]
    a, b = search.draw_candidates(space, 20), search.draw_candidates(space, 20)
    assert a == b
    assert all(0.001 <= c["learning_rate"] <= 0.5 and 3 <= c["max_depth"] < 15 for c in a)


def test_voting_needs_two_members(make):
    scores = make([("a", 1, 1, 0.9)], "model string, doc_id bigint, label int, p double")
    with pytest.raises(ValueError):
        ensemble.soft_vote(scores, ["a"])


def test_weighted_vote(spark, make):
    scores = make([("a", 1, 1, 0.9), ("b", 1, 1, 0.1), ("stacking", 1, 1, 0.0)], "model string, doc_id bigint, label int, p double")
    row = ensemble.weighted_vote(scores, ensemble.weight_table(spark, {"a": 3.0})).first()
    assert row["p"] == pytest.approx((3 * 0.9 + 0.1) / 4)


def test_stack_uses_out_of_fold_scores_only(rows):
    seen = []

    def constant(df):
        seen.append({r["doc_id"] for r in df.select("doc_id").collect()})
        return models.logistic(df, max_iter=5)

    stack = ensemble.stack(rows, {"one": constant, "voting": constant}, folds=2)
    assert list(stack.members) == ["one"]
    assert len(seen) == 3 and not seen[0] & seen[1] and len(seen[2]) == rows.count()
    assert stack.out_of_fold.count() == rows.count()


def test_registry(spark, rows, make, tmp_path):
    registry = ModelRegistry(spark, str(tmp_path / "r"))
    with pytest.raises(FileNotFoundError):
        registry.load()
    registry.save({"lr": models.logistic(rows, max_iter=5)}, make([("lr", 0.5)], "model string, f1 double"))
    fitted, metrics = registry.load()
    assert list(fitted) == ["lr"] and metrics.count() == 1
    name, threshold = training.tune_threshold(registry, rows, rows=100)
    assert name == "lr" and 0 <= threshold <= 1
    assert training.tune_threshold(registry, None) == ("lr", 0.5)
    assert training.tune_threshold(registry, rows, custom=0.2)[1] == 0.2


def test_training_job(rows, tmp_path):
    config = training.JobConfig(
        reduction="pca", components=2, resampling="undersample_2_1", folds=2, models=["random_forest", "adaboost", "nope"],
        save_path=str(tmp_path / "job"),
    )
    tiny = {"random_forest": {"n_estimators": [3], "max_depth": [3]}, "adaboost": {"n_estimators": [2]}}
    result = training.train_and_evaluate(rows, config, spaces=tiny)
    assert {r["model"]: r["state"] for r in result.status.collect()} == {
        "random_forest": "trained", "adaboost": "trained", "nope": "unknown",
    }
    assert {r["model"] for r in result.metrics.collect()} == {
        "random_forest", "adaboost", "voting", "weighted_voting", "stacking",
    }


DOCS = [
    (1, "You stupid idiot, go away"), (2, "What a nice day at the park"), (3, None), (4, "The idiot walks in the park"),
    (5, "A stupid day"), (6, "nice nice park day"),
]


def test_feature_model_is_the_same_at_fit_and_transform(spark, make):
    docs = make(DOCS, "doc_id bigint, text string")
    config = combine.FeatureConfig(
        tfidf=vectorize.TfidfParams(20, 1, 1.0, (1, 1)), word2vec=embed.Word2VecParams(4, 5, 1),
        doc2vec=embed.FactorParams(3, 1, 2), fasttext=embed.SubwordParams(4, 5, 1), topic=TopicParams(2, 20, 2),
    )
    model = combine.FeatureExtractor(config).fit(docs)
    sizes = [(r["family"], r["start"], r["end"]) for r in model.layout(spark).collect()]
    assert [s[0] for s in sizes] == list(config.include)
    assert all(a[2] == b[1] for a, b in zip(sizes, sizes[1:], strict=False))
    out = {r["doc_id"]: r["features"].toArray() for r in model.transform(docs).collect()}
    assert len(out) == 6 and all(len(v) == sizes[-1][2] == len(model.names()) for v in out.values())
    part = {r["doc_id"]: r["features"].toArray() for r in model.transform(docs.filter("doc_id < 3")).collect()}
    for k, v in part.items():
        assert np.allclose(v, out[k])
    topic = out[3][-2:]
    assert topic.sum() == pytest.approx(1.0)
    assert np.all(out[3][sizes[1][1] : sizes[1][2]] == 0)  # no known word: zero vector


def test_own_family_and_failing_family(make):
    docs = make(DOCS, "doc_id bigint, text string")
    extractor = combine.FeatureExtractor(combine.FeatureConfig(include=("lexical",), skip_failing=True))
    extractor.register(
        "shout",
        combine.Family(lambda df, i: combine.Fitted(["n"], 1, lambda new, i, keep: new.select(i, F.length(combine.RAW).alias("n")))),
    )
    extractor.register("broken", combine.Family(lambda df, i: 1 / 0))
    model = extractor.fit(docs.na.fill(""))
    assert list(model.families) == ["lexical", "shout"] and "broken" in model.skipped
    with pytest.raises(ZeroDivisionError):
        strict = combine.FeatureExtractor()
        strict.register("broken", combine.Family(lambda df, i: 1 / 0))
        strict.fit(docs, include=["broken"])


def test_unseen_words_get_subword_vectors(make):
    docs = make([(1, ["stupid", "idiot", "stupid"])], "doc_id bigint, tokens array<string>")
    model = embed.SubwordEmbedding.fit(docs, "tokens", embed.SubwordParams(4, 5, 1))
    new = make([(9, ["stupidest"]), (8, [])], "doc_id bigint, tokens array<string>")
    out = {r["doc_id"]: r["embedding"] for r in model.transform(new, "tokens").collect()}
    assert any(out[9]) and not any(out[8])


def test_topic_shares_sum_to_one(make):
    docs = make([(1, "bad idiot"), (2, "nice day"), (3, "")], "doc_id bigint, clean string")
    model = TopicModel.fit(docs, "clean", TopicParams(2, 10, 3))
    for r in model.transform(docs, "clean").collect():
        assert sum(r["topics"]) == pytest.approx(1.0)


def test_comment_files(spark, make, tmp_path):
    header = "id,comment_text,toxic,severe_toxic,obscene,threat,insult,identity_hate\n"
    (tmp_path / "train.csv").write_text(header + '1,"two\nlines, ""quoted""",1,0,0,0,1,0\n2,plain,0,0,0,0,0,0\n')
    data = CommentData(spark, str(tmp_path))
    assert data.load("test") is None
    out = {r["id"]: (r["comment_text"], r["insult"]) for r in data.load("train").collect()}
    assert out == {1: ('two\nlines, "quoted"', 1), 2: ("plain", 0)}
    with pytest.raises(ValueError):
        data.load("other")
    with pytest.raises(ValueError):
        with_target(make([(1,)], "doc_id bigint"), make([(1,)], "doc_id bigint"), "toxic")


def test_feature_store_builds_once(spark, make, tmp_path):
    store, calls = FeatureStore(spark, str(tmp_path)), []

    def build():
        calls.append(1)
        return make([(1,)], "doc_id bigint")

    for config in ({"k": 1}, {"k": 1}, {"k": 2}):
        assert store.get_or_build("f", config, build).count() == 1
    assert len(calls) == 2


def test_scratch_folder_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from modlens.sources.tables import scratch_folder

    session = lambda master, folder: SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master=master)
    )
    assert scratch_folder(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch_folder(session("local[8]", None))
    with pytest.raises(ValueError):
        scratch_folder(session("yarn", None))
