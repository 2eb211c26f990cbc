"""Jaccard join against all pairs."""

from __future__ import annotations

import os
import random
from itertools import combinations

import numpy as np
import pytest

from modlens.llm import jaccard_join as join_module
from modlens.llm.components import components
from modlens.llm.jaccard_join import PartEnum, jaccard_join, one_per_group, shingle_sets


def exact(rows, n, percent):
    sets = {}
    for i, t in rows:
        words = [w.lower() for w in (t or "").encode().split()]
        grams = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}
        sets[i] = grams
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            low, high = sorted((label[a], label[b]))
            label = {i: low if c == high else c for i, c in label.items()}
    return {i: (len(s), label[i]) for i, s in sets.items()}


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        k, at = rng.randrange(3), rng.randrange(len(words))
        if k == 0:
            words[at] = f"new{rng.randrange(10**6)}"
        elif k == 1:
            words.insert(at, f"new{rng.randrange(10**6)}")
        elif len(words) > 3:
            del words[at]
    return words


@pytest.fixture(scope="module")
def copies():
    """Groups of copies with few and many edits, of short and long texts, and chains of copies."""
    rng = random.Random(5)
    rows = []
    for size in (4, 9, 12, 20, 33, 60, 200):
        base = [f"w{rng.randrange(1000)}" for _ in range(size)]
        rows.append(base)
        for _ in range(14):
            rows.append(edited(rng, base, rng.randrange(0, max(2, size // 20))))
        for _ in range(8):
            base = edited(rng, base, max(1, size // 60))
            rows.append(base)
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_equals_all_pairs(docs_of, copies, n, percent):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(docs_of(copies), n, percent).collect()}
    assert got == exact(copies, n, percent)
    assert len({c for _, c in got.values()}) < len(copies) - 40


@pytest.mark.parametrize("limit", [-1.0, 16])
def test_members_that_share_a_second_passage(docs_of, monkeypatch, limit):
    """Documents of one passage, some of which share another: by prefixes, and by the rarest elements."""
    from modlens.llm import jaccard_join as module

    monkeypatch.setattr(module, "PAIRS_PER_MEMBER", limit)
    rng = random.Random(8)
    word = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    one, two, rows = word(30), word(30), []
    for i in range(40):
        rows.append([*one, *(two if i % 2 else []), *word(25)])
        if i % 4 == 0:
            rows += [edited(rng, rows[-1], 2), edited(rng, rows[-1], 3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(docs_of(rows), 5, 80).collect()}
    assert got == exact(rows, 5, 80)


def test_odd_rows(docs_of, odd):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(docs_of(odd), 3, 90).collect()}
    assert got == exact([r[:2] for r in odd], 3, 90)
    kept = one_per_group(docs_of(odd))
    assert set(kept.columns) >= {"doc_id", "text", "score", "line"}
    assert sorted(r[0] for r in kept.collect()) == [i for i, (_, c) in sorted(exact([r[:2] for r in odd], 5, 80).items()) if i == c]


def test_empty_table(docs_of):
    assert jaccard_join(docs_of([])).collect() == []


def test_signatures_are_shared():
    """Any two sets that are similar enough share a signature."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        enum = PartEnum(percent)
        for size in [*range(1, 60), 100, 333]:
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            apart = int(2 * size * (100 - percent) / (100 + percent))
            out = apart // 2
            b = np.unique(np.concatenate([a[out:], rng.integers(0, 2**63, apart - out).astype(np.uint64)]))
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
                assert set(enum.signatures(a).tolist()) & set(enum.signatures(b).tolist())


def test_shingles_cross_no_text():
    sets = list(shingle_sets([b"a b c", b"", b"A b", b"c d e f"], 3))
    assert [len(s) for s in sets] == [1, 0, 1, 2]


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_one_per_group_keeps_one_row_of_repeats_and_rows_without_id(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long, 1), (None, long, 2), (None, "other words stay here", 3), (1, long, 4), (1, long, 5), (2, "two rows of one id", 6),
            (2, "with quite different texts inside", 7), (3, long + " end", 8), (4, None, 9), (4, None, 10), (5, "", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    kept = one_per_group(docs, 5, 80)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    want = [(None, long), (None, "other words stay here"), (1, long), (2, rows[5][1]), (2, rows[6][1]), (4, None), (5, "")]
    assert got == sorted(want, key=str)
    assert one_per_group(docs.where("false")).count() == 0


def test_a_write_leaves_no_shuffle_setting_behind(spark):
    from modlens.llm.common import FREE_SHUFFLES, written

    before = spark.conf.get(FREE_SHUFFLES, None)
    table = written(spark.range(100).groupBy("id").count(), "t")
    assert table.count() == 100 and spark.conf.get(FREE_SHUFFLES, None) == before


def test_many_pairs_are_compared_in_parts(spark, docs_of, monkeypatch):
    """The texts of a part's pivots travel, not those of all; the pairs found are the same."""
    words = [f"w{i}" for i in range(40)]
    rows = [(100 * g + i, " ".join([f"g{g}", *words[:i], "x", *words[i + 1 :]])) for g in range(12) for i in range(6)]
    docs = docs_of(rows)
    pairs = spark.createDataFrame([(100 * g, 100 * g + i) for g in range(12) for i in range(1, 6)], "a long, b long")
    whole = sorted(join_module.compared(docs, pairs, 3, 60).collect())
    sizes, write = [], join_module.written

    def spied(df, name):
        table = write(df, name)
        sizes.append(table.count() if name == "wanted" else 0)
        return table

    monkeypatch.setattr(join_module, "written", spied)
    monkeypatch.setattr(join_module, "PAIRS_PER_PASS", 15)
    found = join_module.compared(docs, pairs, 3, 60)
    assert sorted(found.collect()) == whole and len(whole) == len(pairs.collect())
    assert sum(sizes) == 72 and max(sizes) < 72
    assert "_SUCCESS" in os.listdir(found.scratch_path)


def test_signatures_of_many_documents_are_counted_in_parts(docs_of, copies, monkeypatch):
    """A part's signatures are unfolded and shuffled, not all of them; the components are the same."""
    rows, yielded, stars = copies[:60], [], join_module._stars

    def spied(base, found):
        for part in stars(base, found):
            yielded.append(part.count())
            yield part

    monkeypatch.setattr(join_module, "_stars", spied)
    monkeypatch.setattr(join_module, "DOCS_PER_PASS", 15)
    got = {r[0]: (r[1], r[2]) for r in jaccard_join(docs_of(rows), 3, 90).collect()}
    assert got == exact(rows, 3, 90) and len(yielded) == join_module.PASSES and sum(yielded) > 0
