"""Words looked up inside rows: short and long tables, frequent and rare words, against plain dictionaries."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from modlens.functions import lookup
from modlens.functions import text as T
from modlens.functions import wordlists as W
from modlens.functions.stemming import porter_stem, stemmed
from modlens.operators import embed, pos


@pytest.fixture(scope="module")
def docs(spark):
    """One word stands in 90 % of the documents; ids repeat and may be null."""
    rng = random.Random(3)
    rows = []
    for i in range(200):
        tokens = [rng.choice([f"w{rng.randrange(400)}", "cats", "women", "boxes"]) for _ in range(rng.randrange(12))]
        rows.append((None if i % 50 == 0 else i // 2, ["hot"] * (i % 10 > 0) + tokens, i))
    rows += [(500, [], 500), (501, None, 501)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>, row int")


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(f"w{i}", f"v{i}") for i in range(0, 1000, 2)] + [("hot", "H")], "word string, value string")


def by_row(df, col):
    return {r["row"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("held", [lookup.HELD, 5, 1])
def test_map_words(docs, table, held):
    known = {r["word"]: r["value"] for r in table.collect()}
    found = lookup.map_words(docs, "doc_id", "tokens", table, "found", held)
    assert found.columns == [*docs.columns, "found"]
    expected = {i: None if ts is None else [known.get(t) for t in ts] for i, ts in by_row(docs, "tokens").items()}
    assert by_row(found, "found") == expected


def test_split_join(spark, docs, table):
    rows = docs.select("row", F.explode("tokens").alias("word"))
    plain = sorted(map(tuple, rows.join(table, "word").collect()))
    for held in (1, 3, 10_000):
        assert sorted(map(tuple, lookup.split_join(rows, table, "word", held).collect())) == plain


def test_mean_pool_of_a_hot_word(spark, docs):
    vectors = spark.createDataFrame([(f"w{i}", [float(i), 1.0]) for i in range(300)] + [("hot", [5.0, 0.0])], "word string, v array<double>")
    vectors = vectors.select("word", array_to_vector("v").alias("vector"))
    own = docs.filter("doc_id is not null").select(F.col("row").cast("long").alias("doc_id"), "tokens").filter("tokens is not null")
    got = {r["doc_id"]: r["embedding"] for r in embed.mean_pool(own, "tokens", vectors, 2).collect()}
    for i, ts in ((r["doc_id"], r["tokens"]) for r in own.collect()):
        known = [[5.0, 0.0] if t == "hot" else [float(t[1:]), 1.0] for t in ts if t == "hot" or t[0] == "w" and t[1:].isdigit() and int(t[1:]) < 300]
        expected = [sum(c) / len(known) for c in zip(*known, strict=True)] if known else [0.0, 0.0]
        assert got[i] == pytest.approx(expected)


def test_noun_rule_in_python_and_sql_and_with_a_table(spark, monkeypatch):
    words = ["cats", "boxes", "buses", "wolves", "cities", "women", "men", "is", "glass", "ses", "s", "men's", "churches", "x", *W.NOUN_EXCEPTIONS]
    nouns = [*W.NOUNS, "cat", "box", "bus", "wolf", "city", "woman", "church"]
    df = spark.createDataFrame([(1, words), (2, []), (3, words[:2] * 40)], "doc_id long, tokens array<string>")
    by_sql = {r[0]: r[1] for r in df.select("doc_id", T.lemmatise(F.col("tokens"), nouns)).collect()}
    monkeypatch.setattr(T, "LITERAL_WORDS", 3)
    assert {r[0]: r[1] for r in df.select("doc_id", T.lemmatise(F.col("tokens"), nouns)).collect()} == by_sql
    table = spark.createDataFrame([(n,) for n in nouns], "noun string")
    got = T.lemmatise_with_table(df, "doc_id", "tokens", table).select("doc_id", "lemmas")
    assert {r[0]: r[1] for r in got.collect()} == by_sql


def test_cleaning_with_a_noun_table_and_stems(spark, tmp_path):
    nouns = [*W.NOUNS, "gizmo", *(f"n{i}" for i in range(30_000))]
    spark.createDataFrame([(n,) for n in nouns], "noun string").write.parquet(str(tmp_path / "nouns"))
    df = spark.createDataFrame([(1, "Gizmos n7s running @me www.x.y"), (2, None), (3, "")], "doc_id long, text string")
    with_list = T.CleanOptions(stemming=True, nouns=tuple(nouns))
    with_table = T.CleanOptions(stemming=True, noun_table=str(tmp_path / "nouns"))
    a = {r["doc_id"]: r["c"] for r in T.clean_columns(df, "text", "c", "doc_id", with_list).collect()}
    b = {r["doc_id"]: r["c"] for r in T.clean_columns(df, "text", "c", "doc_id", with_table).collect()}
    assert a == b == {1: "gizmo n7 run", 2: "", 3: ""}
    with pytest.raises(ValueError):
        T.preprocess(F.col("text"), with_table)


def test_stems_stay_in_their_rows(spark):
    words = ["running", "hopping", "caresses", "ponies", "y", "", "sky", "hot"] * 3
    df = spark.createDataFrame([(1, words), (2, []), (3, None)], "doc_id long, tokens array<string>")
    out = df.select("doc_id", stemmed(F.col("tokens")).alias("s"))
    assert {r["doc_id"]: r["s"] for r in out.collect()} == {1: [porter_stem(w) for w in words], 2: [], 3: None}
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_pos_with_a_tag_table_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(1, "The quick dogs ran quickly."), (2, None), (3, "the the the")], "doc_id long, text string")
    own = pos.pos_features(df)
    assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
    given = pos.pos_features(df, tag_table=pos.starter_tags(spark))
    assert sorted(map(tuple, given.collect())) == sorted(map(tuple, own.collect()))
