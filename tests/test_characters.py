"""Counts over batches of texts against the patterns that they stand for."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import pytest

from modlens.functions import characters as C
from modlens.functions import scores as S
from modlens.operators import pos, sentiment

TEXTS = [
    "e", "ed ed", "the made me", "bed hated passes boxes horses sees less ies es ed e d s", "ee eed ped led ted ded ale l'e",
    "Wait... what? NO!! one two three. a b. ?! lead in words", " ! . ", "", "…", "İstanbul ΑΣ ǅ ß",
    "naïve élan œuvre ÿ", "\U0001d518\U0001d49c \U0001f600\U0001f600 e", "a b c\x85d", "x.y.z a.b c!d e?f g h i",
    "٣٤ 12,3.4 1st", "a1b2 A-B!!! c.d.", "abc" * 9 + " " * 7,
]
SPACES = "[ \t\n\r\f\x0b\x1c-\x1f\x85   -     　]+"
PUNCT = r"[!-/:-@\[-`{-~]"
SILENT = f"e(?:(?<=[^l{C.VOWELS} ]e)|d(?<=[^td{C.VOWELS} ]ed)|s(?<=[^szxchg{C.VOWELS} ]es))(?= |$)"


def words(text):
    return [w for w in re.split(SPACES, text) if w]


def syllables(text):
    own = words(re.sub(PUNCT, "", text))
    groups = re.sub(f"[{C.VOWELS}]+", "*", re.sub(SILENT, "", " ".join(own)))
    n = [max(1, len(g)) for g in re.sub("[^* ]", "", groups).split(" ")] if own else []
    return len(own), sum(map(len, own)), sum(n), sum(x >= 3 for x in n)


def sentences(text):
    return sum(len(words(s)) > 2 for s in re.findall("[^.!?]+[.!?]*", text)), len(re.sub(SPACES, "", text))


def lexical(text):
    kinds = [unicodedata.category(c) for c in text]
    return len(re.findall("[.!?]+", text)), len(re.findall(PUNCT, text)), kinds.count("Lu"), kinds.count("Nd")


@pytest.mark.parametrize("size", [1, 40, 1 << 20])
@pytest.mark.parametrize(("count", "plain"), [(C.lexical_counts, lexical), (C.sentence_counts, sentences), (C.syllable_counts, syllables)])
def test_counts_are_those_of_the_patterns(monkeypatch, size, count, plain):
    monkeypatch.setattr(C, "SLICE", size)
    texts = pa.array(TEXTS * 3).slice(2)
    names = [str(i) for i in range(len(plain("")))]
    got = C.counted([texts], count, names)
    assert [tuple(r.values()) for r in got.to_pylist()] == [plain(t) for t in texts.to_pylist()]


def test_words_of_letters():
    tokens = pa.array([["a", "bc", "a", "b1", "."], [], ["été", "A", "a"], ["1"]]).slice(1)
    assert [c.tolist() for c in C.word_counts(tokens)] == [[0, 3, 0], [0, 3, 0], [0, 5, 0]]
    assert [c.tolist() for c in C.word_counts(pa.array([[]], pa.list_(pa.string())))] == [[0], [0], [0]]


def test_found_tags_come_before_the_suffix_rules():
    tokens, found = pa.array([["runs", "quickly", "!"], []]), pa.array([[None, "NN", None], []], pa.list_(pa.string()))
    own, given = pos._counts(tokens, None).to_pylist(), pos._counts(tokens, found).to_pylist()
    assert own[0] != given[0] and not any(given[1].values())
    assert pos._suffix_tags(pa.array(["12,3", "!", "gladly", "s", "as", "cat"])) == ["CD", "SYM", "RB", "NN", "NNS", "NN"]


def test_text_features_run_no_function_for_every_character(spark, make):
    df = make([(1, "One. Two!")], "doc_id bigint, text string")
    for frame in (S.readability_features(df), pos.pos_features(df), S.lexical_features(df)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "regexp_extract_all" not in plan and "regexp_count" not in plan


def test_sentiment_context_of_batches():
    tokens = pa.array([["skipped"], ["NOT", "very", "\"Good\"", "but", "((", "good!", "But"], [], ["so", "bad"]]).slice(1)
    got = sentiment.reader(frozenset({"good", "bad"}))(tokens).to_pylist()
    hit = lambda pos, *words: dict(zip(("pos", "token", "p1", "p2", "p3"), (pos, *words), strict=True))
    assert got == [
        {"n_caps": 1, "but_at": 3, "hits": [hit(2, "Good", "very", "NOT", None), hit(5, "good", "((", "but", "Good")]},
        {"n_caps": 0, "but_at": -1, "hits": []},
        {"n_caps": 0, "but_at": -1, "hits": [hit(1, "bad", "so", None, None)]},
    ]
    assert [len(r["hits"]) for r in sentiment.reader(None)(tokens).to_pylist()] == [7, 0, 2]
