from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest

from modlens.operators import vectorize

DOCS = [["a", "b", "a", "b", "a"], [], None, ["c"], ["a b", "a"], ["b", "a", "b"], ["é", "é", "é", "é"]]


def counted(low, high):
    df, tf = Counter(), Counter()
    for words in DOCS:
        grams = [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words or []) - n + 1)]
        tf.update(grams), df.update(set(grams))
    return df, tf


@pytest.mark.parametrize("low, high", [(1, 1), (1, 3), (2, 2)])
def test_counts_of_ngrams(make, low, high):
    rows = make([(w,) for w in DOCS], "terms array<string>")
    got = {r["term"]: (r["df"], r["tf"]) for r in vectorize.document_frequency(rows, (low, high)).collect()}
    df, tf = counted(low, high)
    assert got.keys() == tf.keys()
    assert {t: n for t, (_, n) in got.items()} == tf
    # "a b" as a term and as two terms of other documents is one term
    assert all(got[t][0] == df[t] for t in df)


def test_a_batch_yields_each_ngram_once_or_twice():
    """Before, every document gave a row for each of its terms."""
    batches = vectorize._counted(pa.array([["x", "y", "z"]] * 1000), 1, 3)
    assert sum(b.num_rows for b in batches) == 6


def test_ngrams_are_counted_in_slices_of_documents(monkeypatch):
    """A task holds the n-grams of a few documents, not of a whole batch; the counts are the same."""
    words = pa.array([["a", "b", "a"], None, [], ["c"] * 9, ["a", "b"], ["b"]], pa.list_(pa.string()))
    monkeypatch.setattr(vectorize, "WORDS", 4)
    slices = list(vectorize._slices(words))
    assert [len(s) for s in slices] == [3, 1, 2] and pa.concat_arrays(slices).to_pylist() == words.to_pylist()
    found = {}
    for part in slices:
        for batch in vectorize._counted(part, 1, 2):
            for row in batch.to_pylist():
                df, tf = found.get(row["term"], (0, 0))
                found[row["term"]] = df + row["df"], tf + row["tf"]
    assert found == {"a": (2, 3), "b": (3, 3), "c": (1, 9), "a b": (2, 2), "b a": (1, 1), "c c": (1, 8)}
