"""The divergence audit: the perfect hash, the recount and the values against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from modlens.llm import divergence as dv


def test_perfect_hash_is_minimal_and_verifies():
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 5000):
        terms = sorted({"".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 12))).encode() for _ in range(n)})
        seed, pilots, stored = dv.PerfectHash.build(terms)
        found = dv.PerfectHash(seed, pilots, stored, len(terms))
        slots = found.slots(terms, dv.hashes(terms))
        assert sorted(slots.tolist()) == list(range(len(terms)))
        assert [stored.split(b" ")[s] for s in slots] == terms
        known = set(terms)
        strange = [t for t in {t + b"x" for t in terms} | {t[:-1] + b"z" for t in terms} if t not in known]
        assert (found.slots(strange, dv.hashes(strange)) == -1).all()


def test_shares_are_exact():
    rng = random.Random(1)
    for _ in range(200):
        v, total = rng.randint(1, 10**6), rng.choice([0, 5, 10**4, 10**12, 9 * 10**15 - 10**6])
        counts = [0, total, rng.randint(0, total), min(total, 3)]
        exact = [1 + 10**9 * (c + 1) // (total + v) for c in counts]
        assert dv.shares(np.array(counts), total, v).tolist() == exact
    assert dv.excess(np.array([10**9 + 1, 5]), np.array([1, 7])).tolist() == [10**18, 0]


def brute(rows, min_docs=3, top=200):
    docs = [
        (lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)})
         for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")])
        for _, text, lang, source in rows
    ]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        every = sum((counts[lang, s] for s in own), Counter())

        def share(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in own}, share(every)
        for s in own:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in own - {s}]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                items = items[:top] if part == "term" else items
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def made(n, seed=5):
    rng = random.Random(seed)
    words = ["one", "Two", "ÉTÉ", "été", "日本", "x9y", "don't", "k l", "straße", *(f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9))]
    return [
        (i, rng.choice(["", " ", ", ", "\n"]).join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 30))),
         rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s1", "s2", "S3", None, "é"]))
        for i in range(n)
    ]


def rows_of(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("broadcast_bytes", [dv.BROADCAST, 0])
def test_against_brute_force(docs_of, broadcast_bytes):
    rows = made(150)
    assert rows_of(dv.divergence(docs_of(rows), broadcast_bytes=broadcast_bytes)) == brute(rows)


@pytest.mark.parametrize("broadcast_bytes", [dv.BROADCAST, 0])
def test_many_shards_and_tiles(docs_of, monkeypatch, broadcast_bytes):
    """Several shards a language, several tiles of sources, cut after few terms."""
    rows = made(120, seed=9)
    rows = [(i, t, lang, f"s{i % 7}") for i, t, lang, _ in rows]
    monkeypatch.setattr(dv, "SHARD", 16)
    monkeypatch.setattr(dv, "SOURCES", 3)
    assert rows_of(dv.divergence(docs_of(rows), top=5, broadcast_bytes=broadcast_bytes)) == brute(rows, top=5)


def test_odd_rows(docs_of, odd):
    assert rows_of(dv.divergence(docs_of(odd))) == brute(odd)
    assert rows_of(dv.divergence(docs_of(odd), min_docs=100)) == brute(odd, min_docs=100)
    assert rows_of(dv.divergence(docs_of([]))) == []
    same = [(1, "a b a", "en", "s")] * 4 + [(2, None, "en", "t"), (3, "long " * 40_000, "en", "t")]
    assert rows_of(dv.divergence(docs_of(same))) == brute(same)


def test_counts_of_a_task_are_passed_on_in_parts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(dv, "HELD", 3)
    batch = pa.RecordBatch.from_pydict({"text": ["a b c d A", "a a", None, "é b"], "lang": ["x", "x", "x", ""]})
    got = Counter()
    for part in dv._document_frequencies([batch]):
        for r in part.to_pylist():
            got[r["lang"], r["term"]] += r["df"]
    assert got == {("x", "a"): 2, ("x", "b"): 1, ("x", "c"): 1, ("x", "d"): 1, ("", "é"): 1, ("", "b"): 1}
