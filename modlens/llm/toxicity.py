"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one that adds the wording peculiar to toxic text. A
document is cut into windows of ``WINDOW`` words; how many bytes a window needs less with the toxic dictionary than
with the ordinary one is its distance. A logistic threshold on the document's distances (largest, mean of the
largest, number beyond fixed marks) is calibrated on labelled documents that trained no dictionary.

Learning uses a bounded sample: at most ``SAMPLE`` labelled documents of each class, chosen by hash of the id, of at
most ``SAMPLE_CHARS`` characters each. Scoring reads every text whole and looks at nothing but the text.

How the toxic dictionary is trained: zstandard's own trainer picks segments by frequency alone, which in toxic
documents is mostly ordinary prose and separates the classes badly (area under the curve 0.6 on held-out rows
of the 10,000-document table, against 0.95). So segments are picked by what is frequent in toxic documents *and*
rare in ordinary ones, and both dictionaries share the ordinary segments, so that an ordinary window costs the same.

Edge cases: null, empty and blank texts have no window and get the score of distance 0; without labels of both
classes every score is 0; repeated rows are scored alike; other columns of the input are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import logistic
from .common import crc_remainder, spread, text_blocks

WINDOW = 8
LEVEL = 5
ORDINARY_BYTES = 65_536
TOXIC_BYTES = 16_384
SAMPLE = 3000
SAMPLE_CHARS = 50_000
# A segment is peculiar to toxic text from this support (documents, and different neighbourhoods) and log ratio on.
SUPPORT = 5
LIFT = 2.5
# Ordinary documents weigh this many times a toxic one in all when the threshold is calibrated.
ORDINARY_WEIGHT = 4.0
MARKS = (2, 3, 4, 6)
_EDGES = b".,!?;:%&$*#|\"'()[]"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def windows_of(words: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    threshold: logistic.Logistic | None

    def compressors(self):
        return _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=8 * WINDOW, dict_size=ORDINARY_BYTES, write_content_size=0, write_checksum=0,
        write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    content = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


def distances(text: str | None, ordinary, toxic) -> np.ndarray:
    """Bytes that each window needs less with the toxic dictionary."""
    one, other = ordinary.compress, toxic.compress
    return np.array([len(one(w)) - len(other(w)) for w in windows_of(words_of(text))], dtype=np.float64)


def features(d: np.ndarray) -> list[float]:
    if not len(d):
        return [0.0] * (5 + 2 * len(MARKS))
    top = np.sort(d)[::-1]
    counts = [float((d >= m).sum()) for m in MARKS]
    return [
        top[0], top[:2].mean(), top[:3].mean(), np.maximum(d, 0).mean(), np.log1p(len(d)),
        *np.log1p(counts), *(c / len(d) for c in counts),
    ]


def _support(documents: list[list[bytes]]) -> dict[bytes, int]:
    """For each word, the number of documents or of different neighbourhoods it occurs in, the smaller one: copies
    of a text repeat neighbourhoods, a text that repeats a word is one document. Counted on word numbers, since sets of
    neighbours would take the driver twenty times the text."""
    numbers: dict[bytes, int] = {b"": 0}
    rows = [np.array([numbers.setdefault(w.strip(_EDGES), len(numbers)) for w in words], np.int32) for words in documents if words]
    if not rows:
        return {}
    n, none = len(numbers), np.zeros(1, np.int32)

    def distinct(others: np.ndarray) -> np.ndarray:
        """For each word, how many different numbers stand beside it."""
        key = others.astype(np.int64) * n + np.concatenate(rows)
        key.sort()
        return np.bincount(key[np.concatenate([[True], key[1:] != key[:-1]])] % n, minlength=n)

    within = distinct(np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows]))
    beside = np.concatenate([x for r in rows for x in (none, r[:-1])]).astype(np.int64) * n
    beside += np.concatenate([x for r in rows for x in (r[1:], none)])
    kinds = np.unique(beside)
    differing = distinct(np.searchsorted(kinds, beside).astype(np.int32))
    least = np.minimum(differing, within).tolist()
    return {w: least[i] for w, i in numbers.items() if w}


def train(sample: list[tuple[int, str, int]]) -> ToxicityModel:
    """A model from labelled (doc_id, text, toxic) rows."""
    once: dict[bytes, bytes] = {}  # each word is held once, however often it occurs
    toxic, ordinary = (
        [[once.setdefault(w, w) for w in words_of(t)] for i, t, y in sample if y == label and crc_remainder(i, 7) > 1] for label in (1, 0)
    )
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", None)
    here, there = _support(toxic), _support(ordinary)
    n_here, n_there = sum(here.values()), sum(there.values())
    lift = {
        w: log(n / n_here) - log((there.get(w, 0) + 0.5) / n_there)
        for w, n in here.items()
        if n >= SUPPORT and len(w) >= 3
    }
    # The end of a dictionary is the cheapest to refer to, so the most frequent segments come last.
    peculiar = sorted((w for w in lift if lift[w] >= LIFT), key=lambda w: (here[w] * lift[w], w))
    toxic_content = (b" " + b" ".join(peculiar) + b" ")[-TOXIC_BYTES:] if peculiar else b""
    counts = Counter(w for words in ordinary for w in words)
    known, chosen, size = set(peculiar), [], 0
    for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if w.strip(_EDGES) in known or len(w) > 64:
            continue
        size += len(w) + 1
        if size > ORDINARY_BYTES:
            break
        chosen.append(w)
    model = ToxicityModel(b" " + b" ".join(reversed(chosen)) + b" ", toxic_content, None)
    held = [(t, y) for i, t, y in sample if crc_remainder(i, 7) <= 1]
    y = np.array([y for _, y in held], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return model
    pair = model.compressors()
    x = np.array([features(distances(t, *pair)) for t, _ in held])
    importance = np.where(y == 1, 1.0, ORDINARY_WEIGHT * y.sum() / (len(y) - y.sum()))
    return ToxicityModel(model.ordinary, model.toxic, logistic.fit(x, y, importance))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> ToxicityModel:
    """A model from labelled documents for which ``allowed`` holds, within the bounds of the sample."""
    rows = (
        labels.where("toxic in (0, 1)")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(allowed)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    pick = F.xxhash64("doc_id")
    chosen = rows.where("toxic = 1").orderBy(pick).limit(SAMPLE).union(rows.where("toxic = 0").orderBy(pick).limit(SAMPLE))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"length(text) <= {SAMPLE_CHARS}")
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text"), F.max("toxic"))
    return train(sorted(tuple(r) for r in found.collect()))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted, max_distance of every document."""

    def run(batches):
        pair = model.compressors() if model.threshold else None
        for block in text_blocks(batches):
            texts = block.column(1).to_pylist()
            x = np.array([features(distances(t, *pair)) for t in texts]) if pair else None
            p = model.threshold(x) if pair else np.zeros(len(texts))
            largest = x[:, 0] if pair else p
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(p), pa.array((p >= 0.7).astype(np.int32)), pa.array(largest)],
                ["doc_id", "score", "predicted", "max_distance"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(slim).mapInArrow(run, "doc_id long, score double, predicted int, max_distance double")


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    return score(docs, learn(docs, labels, allowed))
