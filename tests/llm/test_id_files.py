"""The id coder and its files: exact round trips, damage, positions against a plain recount."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from modlens.llm import id_coder, id_files
from modlens.llm.common import written

PATH = public_tokenizers.path("byte_bpe_50k.json")


def same(blocks):
    got = id_coder.decode(id_coder.encode(blocks))
    assert len(got) == len(blocks) and all((a == b).all() and len(a) == len(b) for a, b in zip(got, blocks, strict=True))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 5), st.integers(0, 2**32 - 1)), min_size=1, max_size=200), min_size=1, max_size=6))
def test_any_blocks_come_back(blocks):
    same([np.array(b, dtype=np.uint32) for b in blocks])


def test_blocks_of_many_kinds():
    rng = np.random.default_rng(4)
    same([
        np.zeros(9000, np.uint32), np.arange(5000, dtype=np.uint32), np.array([2**32 - 1], np.uint32),
        rng.integers(0, 50_000, 8192).astype(np.uint32), np.tile(rng.integers(0, 900, 50), 100).astype(np.uint32),
        rng.integers(0, 2, 4000).astype(np.uint32), np.repeat(np.arange(40), 70).astype(np.uint32),
    ])
    assert id_coder.encode([]) == [] and id_coder.decode([]) == []


def test_blocks_do_not_depend_on_their_neighbours(monkeypatch):
    rng = np.random.default_rng(5)
    blocks = [rng.zipf(1.3, n).clip(0, 40_000).astype(np.uint32) for n in (3000, 20, 1, 2999, 700)]
    together = id_coder.encode(blocks)
    assert together == [id_coder.encode([b])[0] for b in blocks]
    monkeypatch.setattr(id_coder, "LANES", 2)
    assert together == id_coder.encode(blocks)
    same(blocks)


def test_prediction_pays():
    """A repeated passage costs less than half a bit an id, two ids of unlike frequency less than a third of one."""
    rng = np.random.default_rng(6)
    passage = np.tile(rng.integers(0, 50_000, 100), 80).astype(np.uint32)
    assert len(id_coder.encode([passage])[0]) * 8 < 0.5 * len(passage)
    skewed = np.repeat([7, 9], [7900, 100]).astype(np.uint32)
    rng.shuffle(skewed)
    assert len(id_coder.encode([skewed])[0]) * 8 < 0.3 * len(skewed)


def test_damage_is_seen():
    block = id_coder.encode([np.arange(3000, dtype=np.uint32) % 70])[0]
    for at in (0, 5, 9, 20, 30, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError, match="damaged"):
            id_coder.decode([bytes(bad)])
    segment = id_files.pack_segment([1, None], [np.array([5, 6], np.uint32), np.array([2], np.uint32)])
    assert [(a, b.tolist(), c.tolist()) for a, b, c in id_files.unpack_segments([segment])] == [([1, None], [2, 1], [5, 6, 2])]
    for at in (0, 17, 30, 40, len(segment) - 1):
        bad = bytearray(segment)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="damaged"):
            list(id_files.unpack_segments([bytes(bad)]))
    with pytest.raises(ValueError, match="damaged"):
        list(id_files.unpack_segments([segment[:-1]]))


def plain(rows):
    """Documents in the order of their ids, counted one after the other."""
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def read_back(docs):
    return [tuple(r) for r in id_files.read_ids(written(id_files.write_ids(docs, PATH, 2), "ids")).collect()]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    assert sorted(read_back(docs)) == plain(rows)


def test_several_segments_a_task(spark, docs_of, monkeypatch):
    monkeypatch.setattr(id_files, "SEGMENT", 64)
    rows = [(i, f"word{i} " * (i % 40)) for i in range(60)]
    # the tasks see the module's value, so the segments are made here
    parts = [id_files.pack_segment([i], [np.array([i, 2], np.uint32)]) for i in range(5)]
    assert [d for d, _, _ in id_files.unpack_segments(parts)] == [[0], [1], [2], [3], [4]]
    assert sorted(read_back(docs_of(rows))) == plain(rows)


def test_odd_rows(docs_of):
    texts = [None, "", " \n ", "é", "日本語", "x" * 5000, "<|endoftext|>", "a  b"]
    rows = list(enumerate(texts))
    assert sorted(read_back(docs_of(rows))) == plain(rows)
    assert read_back(docs_of([])) == []


def test_null_and_repeated_ids(docs_of):
    rows = [(None, "a b"), (None, None), (3, "c d e"), (3, "c d e"), (3, "f"), (None, "a b"), (1, "x " * 3000)]
    got = read_back(docs_of(rows))
    assert len(got) == len(rows)
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    order = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert order == [None, None, None, 1, 3, 3, 3]
    alone = lambda rows: sorted((str(i), n, crc) for i, _, n, crc in rows)
    assert alone(got) == alone(plain(rows))
