"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded as numbers (shares of character classes,
word lengths, repetition inside the passage and of earlier passages) and by a small layer; gated attention gives
each passage a weight, and a linear layer scores the weighted representation. Attention is learned from labels of
documents alone.

Learning uses a bounded sample: at most ``SAMPLE`` labelled documents of each class, chosen by hash of the id, of at
most ``SAMPLE_CHARS`` characters each; the driver gets their passages' numbers, not their texts. Scoring reads every
text whole and looks at nothing but the text.

Edge cases: null, empty and blank texts have no passage and score 0; without labels of both classes every score
is 0; repeated rows score alike; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, as_bytes, mixed, spread, text_blocks, word_hashes

PASSAGE = 64
SAMPLE = 3000
SAMPLE_CHARS = 40_000
HIDDEN, GATE = 16, 8
STEPS, RATE, DECAY = 160, 0.03, 1e-4

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "stop": b".,;:?", "shout": b"!", "bar": b"|", "symbol": b"#*$%&<>@^~=+_\\/{}[]", "break": b"\n",
}
_CLASS_OF = np.full(256, len(_CLASSES), dtype=np.int8)  # other bytes: letters beyond ASCII, quotes, brackets
for _k, _members in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_members)] = _k
N_FEATURES = len(_CLASSES) + 1 + 6


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all passages of the texts, in order, and how many passages each text has."""
    words, counts = word_hashes(texts)
    if not len(words):
        return np.zeros((0, N_FEATURES)), np.zeros(len(texts), np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = ~_SPACE[data]
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    passages = -(-counts // PASSAGE)
    owner = np.repeat(np.arange(len(texts)), counts)
    first_word = np.cumsum(counts) - counts
    place = np.arange(len(words)) - first_word[owner]
    heads = np.flatnonzero(place % PASSAGE == 0)
    sizes = np.diff(np.concatenate((heads, [len(words)])))
    # character classes between the starts of passages
    edges = np.concatenate((starts[heads], [len(data)]))
    classes = _CLASS_OF[data]
    shares = np.empty((len(heads), len(_CLASSES) + 1))
    for k in range(len(_CLASSES) + 1):
        shares[:, k] = np.add.reduceat((classes == k) & (inside | (data == 10)), edges[:-1])
    chars = np.add.reduceat(inside, edges[:-1]).astype(np.float64)
    # repetition
    passage = np.cumsum(place % PASSAGE == 0) - 1
    key = mixed(words ^ mixed(passage.astype(np.uint64) + np.uint64(1)))
    distinct = np.bincount(passage[np.unique(key, return_index=True)[1]], minlength=len(heads))
    same_as_last = np.zeros(len(words), bool)
    same_as_last[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    grams = words.copy()
    for i in range(1, 4):
        grams[:-i] = mixed(grams[:-i] * np.uint64(31)) + words[i:]
    grams = mixed(grams ^ mixed(owner.astype(np.uint64) + np.uint64(7)))
    seen = np.ones(len(words), bool)
    seen[np.unique(grams, return_index=True)[1]] = False
    seen &= place < np.repeat(counts, counts) - 3
    add = lambda x: np.add.reduceat(x.astype(np.float64), heads)
    first_ = place[heads] == 0
    numbers = np.column_stack([
        np.sqrt(shares / np.maximum(chars, 1)[:, None]), chars / sizes / 10, distinct / sizes, add(same_as_last) / sizes,
        add(seen) / sizes, np.log1p(sizes) / 4, first_.astype(np.float64),
    ])
    return numbers, passages


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def __call__(self, x: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents and attention of the passages."""
        some = passages > 0
        out = np.zeros(len(passages))
        if not some.any():
            return out, np.zeros(0)
        forward = _forward((x - self.centre) / self.scale, passages[some], self.p)
        out[some] = forward["y"]
        return out, forward["a"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(x: np.ndarray, bags: np.ndarray, p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    first = np.cumsum(bags) - bags
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    e = (t * g) @ p["q"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
    a = e / np.repeat(np.add.reduceat(e, first), bags)
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": _sigmoid(z @ p["c"] + p["d"]), "first": first}


def train(x: np.ndarray, bags: np.ndarray, y: np.ndarray, seed: int = 0) -> QualityModel:
    """Adam on the log loss of all bags; bags: passages of each document (at least one)."""
    rng = np.random.default_rng(seed)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    x, y = ((x - centre) / scale).astype(np.float32), y.astype(np.float32)
    p = {
        "w": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.3, (HIDDEN, GATE)),
        "u": rng.normal(0, 0.3, (HIDDEN, GATE)), "q": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN),
        "d": np.zeros(1),
    }
    p = {k: w.astype(np.float32) for k, w in p.items()}
    m, s = ({k: np.zeros_like(w) for k, w in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        f = _forward(x, bags, p)
        dy = (f["y"] - y) / len(y)
        dz = np.repeat(dy[:, None] * p["c"], bags, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), bags))
        dt, dg = de[:, None] * p["q"] * f["g"], de[:, None] * p["q"] * f["t"]
        dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
        dh = (dz * f["a"][:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        grad = {
            "w": x.T @ dh, "b": dh.sum(0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "q": (f["t"] * f["g"]).T @ de,
            "c": f["z"].T @ dy, "d": dy.sum(keepdims=True),
        }
        for k, g in grad.items():
            g = g + DECAY * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.999 * s[k] + 0.001 * g * g
            p[k] -= RATE * m[k] / (1 - 0.9**step) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(centre, scale, {k: w.astype(np.float64) for k, w in p.items()})


def learn(docs: DataFrame, labels: DataFrame, allowed: Column) -> QualityModel | None:
    rows = (
        labels.where("quality in (0, 1)")
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .where(allowed)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    pick = F.xxhash64("doc_id")
    chosen = rows.where("quality = 1").orderBy(pick).limit(SAMPLE).union(
        rows.where("quality = 0").orderBy(pick).limit(SAMPLE)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(f"length(text) <= {SAMPLE_CHARS}")
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches):
        for block in text_blocks(batches):
            get = lambda name: block.column(block.schema.get_field_index(name))
            x, passages = encode(as_bytes(get("text")))
            ends = np.concatenate(([0], np.cumsum(passages))) * N_FEATURES
            flat = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([get("doc_id"), get("quality"), flat], ["doc_id", "quality", "x"])

    found = joined.mapInArrow(run, "doc_id long, quality int, x array<float>").where("size(x) > 0").toArrow()
    found = found.sort_by("doc_id")
    y = found["quality"].to_numpy().astype(np.float64)
    if not 0 < y.sum() < len(y):
        return None
    flat = found["x"].combine_chunks()
    x = flat.flatten().to_numpy().astype(np.float64).reshape(-1, N_FEATURES)
    return train(x, np.diff(np.asarray(flat.offsets)) // N_FEATURES, y)


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, score (0 to 1), predicted, n_passages and top_passage (number of the passage with most attention,
    null without passages) of every document."""

    def run(batches):
        for block in text_blocks(batches):
            x, passages = encode(as_bytes(block.column(1)))
            y, attention = model(x, passages) if model else (np.zeros(len(passages)), np.zeros(len(x)))
            ends = np.cumsum(passages)
            top = [int(attention[e - n : e].argmax()) if n else None for e, n in zip(ends, passages, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column(0), pa.array(y), pa.array((y >= 0.7).astype(np.int32)), pa.array(passages),
                    pa.array(top, pa.int64()),
                ],
                ["doc_id", "score", "predicted", "n_passages", "top_passage"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(slim).mapInArrow(run, "doc_id long, score double, predicted int, n_passages long, top_passage long")


def quality(docs: DataFrame, labels: DataFrame, allowed: Column) -> DataFrame:
    return score(docs, learn(docs, labels, allowed))
