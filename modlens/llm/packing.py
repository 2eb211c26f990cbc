"""Order-preserving packing of token sequences by dynamic programming.

Documents, in the order of their ids, form one stream of token ids (each document ends with id 0). The stream is
cut into windows of at most ``length`` ids. A cut costs nothing at a document's end, ``SENTENCE_CUT`` at a
sentence's end and ``OPEN_CUT`` at one of the points that lie every ``OPEN_STEP`` ids elsewhere; padding costs one
per id. With S(j) = least cost of the windows up to point j plus the ids up to it,

    S(j) = length + cut(j) + min { S(i) : point(j) - length <= point(i) < point(j) }

so a monotone queue of the points in reach gives every transition in constant time. The stream is dealt to tasks
by ranges of ids, and a task solves it in stretches of bounded length: the last windows of a stretch are solved
again with the next one. Only a task's last window can be far from full; its ids are split into sequences whose
lengths are powers of two, which are not padded.

Edge cases: null and empty texts are documents of one id (0); rows that repeat a doc_id are packed as documents
of their own; the strings of special tokens in a text become what the tokenizer makes of them; other columns
of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_blocks

SENTENCE_CUT = 8
OPEN_CUT = 24
OPEN_STEP = 16
# Ids that a task solves at a time, and windows at its end that are solved again.
STRETCH = 1 << 19
AGAIN = 8
# Chunks of text whose ids a worker remembers.
MEMORY = 500_000
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)


class Encoder:
    """Ids of a byte-level BPE tokenizer file.

    A text is cut before its spaces; such chunks share no token, so each distinct chunk is encoded once and then
    looked up. (A space between other white space is no such place: these texts are encoded as a whole.)
    """

    BETWEEN = re.compile(r"\s (?:\s|$)")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        letters = _byte_letters()
        ranks = {
            bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special
        }
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        bpe = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.ends_sentence = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, i in ranks.items():
            text = token.decode("utf-8", "replace")
            self.ends_sentence[i] = text.endswith((".", "!", "?", "\n", "。", "！", "？"))

        def ids(text: str) -> bytes:
            return array("I", bpe.encode_ordinary(text)).tobytes()

        class Known(dict):
            def __init__(self, prefix: str):
                super().__init__()
                self.prefix = prefix

            def __missing__(self, chunk: str) -> bytes:
                found = ids(self.prefix + chunk)
                if len(chunk) <= 64:
                    self[chunk] = found
                return found

        self.whole, self.first, self.spaced = ids, Known(""), Known(" ")

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.special and self.special.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if self.BETWEEN.search(text):
            return self.whole(text)
        if len(self.spaced) > MEMORY:
            self.spaced.clear()
        if len(self.first) > MEMORY:
            self.first.clear()
        first, *rest = text.split(" ")
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters.update({chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))})
    return letters


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points at which the stream may be cut (number of ids before them), and what each cut costs."""
    cost = np.full(len(ids) + 1, -1, dtype=np.int64)
    cost[::OPEN_STEP] = OPEN_CUT
    cost[-1] = OPEN_CUT
    cost[1:][ends_sentence[ids]] = SENTENCE_CUT
    cost[doc_ends] = 0
    points = np.flatnonzero(cost >= 0)
    return points, cost[points]


def best_cuts(points: np.ndarray, cost: np.ndarray, length: int) -> list[int]:
    """The cheapest increasing cuts from the first to the last point, windows of at most ``length``."""
    at, price = points.tolist(), cost.tolist()
    before = [0] * len(at)
    queue_at, queue_sum, queue_index, head = [at[0]], [0], [0], 0
    for j in range(1, len(at)):
        point = at[j]
        while queue_at[head] < point - length:
            head += 1
        before[j] = queue_index[head]
        total = queue_sum[head] + price[j] + length
        while len(queue_sum) > head and queue_sum[-1] >= total:
            queue_sum.pop()
            queue_at.pop()
            queue_index.pop()
        queue_sum.append(total)
        queue_at.append(point)
        queue_index.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(at[j])
        j = before[j]
    return cuts[::-1]


def power_cuts(start: int, end: int, length: int) -> list[int]:
    """Cuts of a last window: sequences of power-of-two lengths, unless it is nearly full."""
    cuts = []
    while start < end:
        left = end - start
        if length - left <= OPEN_STEP:
            cuts.append(end)
            break
        start += 1 << (left.bit_length() - 1)
        cuts.append(start)
    return cuts


class _Stream:
    """The part of the stream that one task has read and not yet cut."""

    def __init__(self, ends_sentence: np.ndarray, length: int, first_sequence: int):
        self.ends_sentence, self.length, self.sequence = ends_sentence, length, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple] = []  # id, ids of the document that were cut before, ids here, all its ids
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.size += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of the windows that are final."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[2] for d in self.docs])
        cuts = best_cuts(*cut_points(ids, ends, self.ends_sentence), self.length)
        if last:
            start = cuts[-2] if len(cuts) > 1 else 0
            cuts = cuts[:-1] + power_cuts(start, len(ids), self.length)
        else:
            cuts = cuts[:-AGAIN] or cuts[:1]
        pieces, start, k, done = [], 0, 0, 0
        for end in cuts:
            here = start
            while here < end:
                doc_id, skipped, size, total = self.docs[k]
                stop = min(end, done + size)
                crc = zlib.crc32(ids[here:stop])
                pieces.append(
                    (doc_id, skipped + here - done, stop - here, crc, total, self.sequence, here - start, end - start)
                )
                if stop == done + size:
                    done, k = stop, k + 1
                here = stop
            self.sequence, start = self.sequence + 1, end
        rest = self.docs[k:]
        if rest and start > done:
            doc_id, skipped, size, total = rest[0]
            rest[0] = (doc_id, skipped + start - done, size - (start - done), total)
        self.ids, self.docs, self.size = [ids[start:]], rest, len(ids) - start
        return pieces


def pack(docs: DataFrame, tokenizer: str, length: int = 1024) -> DataFrame:
    """One row per piece of a document: doc_id, start (its ids before the piece), length, ids_crc32,
    doc_tokens, sequence_id, offset in the sequence, sequence_length (ids in the sequence)."""

    def run(batches):
        enc = encoder(tokenizer)
        stream = _Stream(enc.ends_sentence, length, TaskContext.get().partitionId() << 36)
        for block in text_blocks(batches):
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text or "") + b"\0\0\0\0", dtype="<u4")
                stream.add(doc_id, ids)
                while stream.size >= STRETCH:
                    yield rows(stream.cut(last=False))
        yield rows(stream.cut(last=True))

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(*pieces, strict=True) if pieces else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names)

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(run, SCHEMA)
