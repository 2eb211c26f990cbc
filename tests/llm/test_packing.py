"""Packing: exact round trip, full sequences, cuts against an exhaustive search."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from modlens.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def check(tokenizer, rows, pieces, length):
    texts = dict(rows)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids, at = ids_of(tokenizer, texts[i]), 0
        for p in sorted(own, key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], dtype="<u4").tobytes()
            assert (p["start"], p["ids_crc32"], p["doc_tokens"]) == (at, zlib.crc32(part), len(ids))
            at += p["length"]
        assert at == len(ids)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length and all(p["sequence_length"] == at for p in own)
        padding += 0 if at & (at - 1) == 0 else length - at
        total += at
    return padding / total


def test_round_trip(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    pieces = [r.asDict() for r in packing.pack(docs, PATH, 1024).collect()]
    assert check(tokenizer, rows, pieces, 1024) < 0.01
    # order is kept: a sequence holds neighbours
    seen = sorted((p["sequence_id"], p["offset"], p["doc_id"], p["start"]) for p in pieces)
    assert [s[2:] for s in seen] == sorted(s[2:] for s in seen)


def test_odd_rows(docs_of, odd, tokenizer):
    pieces = [r.asDict() for r in packing.pack(docs_of(odd), PATH, 64).collect()]
    check(tokenizer, [r[:2] for r in odd], pieces, 64)
    assert packing.pack(docs_of([]), PATH).collect() == []


def test_repeated_ids_are_documents_of_their_own(docs_of):
    pieces = packing.pack(docs_of([(1, "a b c"), (1, "a b c")]), PATH).collect()
    assert sum(p["length"] for p in pieces) == 2 * pieces[0]["doc_tokens"]


def test_chunks_encode_as_the_tokenizer_does(tokenizer):
    rng, enc = random.Random(3), packing.encoder(PATH)
    texts = ["".join(rng.choice(" \n\tab.1'é \x0b　日") for _ in range(30)) for _ in range(500)]
    for t in [*texts, "I'm  he's   x ", "<|endoftext|> a", " ", "a\x1c b"]:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(200):
        points = np.array([0, *sorted(rng.sample(range(1, 40), 14))])
        cost = np.array([rng.choice([0, 2, 5]) for _ in points])
        length = max(12, int(np.diff(points).max()))
        best = [0] + [10**9] * (len(points) - 1)
        for j in range(1, len(points)):
            for i in range(j):
                if points[j] - points[i] <= length:
                    best[j] = min(best[j], best[i] + length - (points[j] - points[i]) + cost[j])
        cuts = [0, *packing.best_cuts(points, cost, length)]
        price = dict(zip(points.tolist(), cost.tolist(), strict=True))
        assert sum(length - (b - a) + price[b] for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


def test_last_window_needs_no_padding():
    assert packing.power_cuts(0, 700, 1024) == [512, 640, 672, 688, 696, 700]
    assert packing.power_cuts(0, 1020, 1024) == [1020]


def test_stretches_meet(monkeypatch, spark, sf_dir, tokenizer):
    """Solving the stream in short stretches loses no id."""
    monkeypatch.setattr(packing, "STRETCH", 4096)
    enc = packing.encoder(PATH)
    stream, pieces, rows = packing._Stream(enc.ends_sentence, 128, 0), [], []
    for i in range(60):
        text = f"word{i} and more. " * (i * 7 % 50)
        rows.append((i, text))
        stream.add(i, np.frombuffer(enc.encode(text) + b"\0\0\0\0", "<u4"))
        while stream.size >= packing.STRETCH:
            pieces += stream.cut(False)
    pieces += stream.cut(True)
    names = [c.split()[0] for c in packing.SCHEMA.split(", ")]
    check(tokenizer, rows, [dict(zip(names, p, strict=True)) for p in pieces], 128)
