"""Skip-gram word vectors with negative sampling, trained on blocks of words.

Words are dealt to B blocks by their hash; the vectors of a block are one row of a table, so no vocabulary and no weight
matrix is ever whole in one place. Pairs of a word and a neighbour are dealt to B x B groups. An epoch has B
steps; step s meets, for every i, the words of block i with the neighbours of block (i + s) mod B: B tasks that share
no vector, each with two blocks and the pairs between them, which stream by. Negatives come from the task's own
block of neighbours; over an epoch a word meets those of all blocks.

Frequent words are thinned out by their share, as in the published method, so that no pair group is swelled by one
word; those are at most 1 / ``sample`` words. Words under ``min_count`` have no vector but keep their place in the window.
Two words whose 64-bit hashes are equal would share a vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.sources.tables import materialise, release, scratch_path, settle, shuffles_freed

# Words of a block: at most where the vocabulary is large, at least where it is small.
MOST_WORDS, LEAST_WORDS = 1 << 15, 1 << 14
# Pairs that a task collects before it passes them on, pairs of an update, negatives that these share.
HELD, UPDATE, SHARED = 1 << 20, 1024, 64
# Length of the longest step that an update takes with one vector. Pairs that share a word are summed before they move it,
# so a word that fills an update would overshoot by more each time, until its vector and those it meets are not finite.
LONGEST = 1.0
# Blocks that one task trains as one, if there are more blocks than tasks at a time.
GATHERED = 8
# Words and pairs that travel in one row, bytes of a row group: readers hold a group at once.
CHUNK, CHUNK_PAIRS, ROW_GROUP = 1 << 9, 1 << 14, 8 << 20


@dataclass(frozen=True)
class SkipGramParams:
    vector_size: int = 100
    window: int = 5
    min_count: int = 1
    epochs: int = 5
    negatives: int = 5
    learning_rate: float = 0.025
    sample: float = 1e-3
    seed: int = 42
    blocks: int | None = None


def _spread(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit integers whose bits all depend on all."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _uniform(hashes: np.ndarray, places: np.ndarray, seed: int) -> np.ndarray:
    """Numbers in [0, 1) from a document's hashed words and their places."""
    start = np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    mixed = _spread(hashes.astype(np.uint64) + _spread(places.astype(np.uint64) + start))
    return (mixed >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def pairs_of(hashes: np.ndarray, keep: dict[int, float], params: SkipGramParams) -> tuple[np.ndarray, np.ndarray]:
    """Words and neighbours of one document. A word's window is drawn from 1 to ``window``."""
    places = np.arange(len(hashes))
    if keep:
        chance = np.array([keep.get(h, 1.0) for h in hashes.tolist()])
        hashes = hashes[_uniform(hashes, places, params.seed) < chance]
        places = np.arange(len(hashes))
    reach = 1 + (_uniform(hashes, places, params.seed + 1) * params.window).astype(np.int64)
    words, others = [], []
    for d in range(1, min(params.window, len(hashes) - 1) + 1):
        left, right = hashes[:-d], hashes[d:]
        forward, back = reach[:-d] >= d, reach[d:] >= d
        words += [left[forward], right[back]]
        others += [right[forward], left[back]]
    if not words:
        return hashes[:0], hashes[:0]
    return np.concatenate(words), np.concatenate(others)


PAIRS = "step int, grp int, part int, words binary, others binary"
BLOCKS = "kind int, block int, chunk int, hashes binary, counts binary, weights binary"


def _pair_groups(df: DataFrame, tokens_col: str, keep: dict[int, float], n: int, params: SkipGramParams) -> DataFrame:
    names = [c.split()[0] for c in PAIRS.split(", ")]

    def run(batches):
        held, size, part = [], 0, TaskContext.get().partitionId()

        def groups():
            words, others = (np.concatenate(x) for x in zip(*held, strict=True))
            i, j = words % n, others % n
            group = i * n + (j - i) % n
            order = np.argsort(group, kind="stable")
            ends = np.searchsorted(group[order], np.arange(n * n), side="right")
            for g in range(n * n):
                start = ends[g - 1] if g else 0
                for first in range(start, ends[g], CHUNK_PAIRS):
                    at = order[first : min(first + CHUNK_PAIRS, ends[g])]
                    row = [g % n], [g // n], [part], [words[at].astype("<i8").tobytes()], [others[at].astype("<i8").tobytes()]
                    kinds = pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            column = batch.column(0)
            for row in column:
                if row.is_valid and len(row.values) > 1:
                    found = pairs_of(row.values.to_numpy(zero_copy_only=False), keep, params)
                    held.append(found)
                    size += len(found[0])
                    if size >= HELD:
                        yield from groups()
                        held, size = [], 0
        if size:
            yield from groups()

    hashed = F.transform(tokens_col, lambda w: F.xxhash64(w))
    return df.select(hashed.alias("h")).mapInArrow(run, PAIRS)


def _stored_pairs(pairs: DataFrame) -> DataFrame:
    """The pairs in a folder a step, so that a step reads its own only."""
    path = scratch_path(pairs.sparkSession, "pairs")
    pairs.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").partitionBy("step").parquet(path)
    return pairs.sparkSession.read.schema(PAIRS).parquet(path)


def _first_blocks(vocabulary: DataFrame, params: SkipGramParams) -> DataFrame:
    """Rows of both kinds (0: words, 1: neighbours) for each block, hashes ascending."""

    def run(batches):
        key, hashes, counts = None, [], []

        def rows():
            h, c = np.concatenate(hashes), np.concatenate(counts)
            rng = np.random.default_rng([params.seed, key])
            weights = ((rng.random((len(h), params.vector_size)) - 0.5) / params.vector_size).astype("<f4")
            for kind, w in ((0, weights), (1, np.zeros_like(weights))):
                yield from _rows(kind, key, h, c, w)

        for batch in batches:
            block, h, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for start, end in _runs(block):
                if key is not None and block[start] != key:
                    yield from rows()
                    hashes, counts = [], []
                key = int(block[start])
                hashes.append(h[start:end])
                counts.append(c[start:end])
        if key is not None:
            yield from rows()

    words = vocabulary.select("block", "hash", "n").repartition("block").sortWithinPartitions("block", "hash")
    return words.mapInArrow(run, BLOCKS)


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(keys)) + 1
    bounds = [0, *edges.tolist(), len(keys)]
    return [(a, b) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def _rows(kind: int, block: int, hashes, counts, weights):
    """A block's rows."""
    names, kinds = [c.split()[0] for c in BLOCKS.split(", ")], (*[pa.int32()] * 3, *[pa.binary()] * 3)
    for chunk, start in enumerate(range(0, len(hashes), CHUNK)):
        part = slice(start, start + CHUNK)
        values = hashes[part].astype("<i8"), counts[part].astype("<i8"), weights[part].astype("<f4")
        row = [[kind], [block], [chunk], *([v.tobytes()] for v in values)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)


def _places(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows of the wanted hashes, -1 where there is none."""
    at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
    return np.where(hashes[at] == wanted, at, -1)


def train(vectors: np.ndarray, context: np.ndarray, counts: np.ndarray, words: np.ndarray, others: np.ndarray, rate: float,
          rng: np.random.Generator, params: SkipGramParams) -> None:
    """Stochastic gradient steps over pairs, in place. An update's pairs share their negatives, weighted so that
    each pair has ``negatives`` of them in expectation."""
    chance = np.cumsum(counts.astype(np.float64) ** 0.75)
    share = np.float32(params.negatives / SHARED)
    size = max(8, min(UPDATE, len(vectors) // 4))
    order = rng.permutation(len(words))
    for start in range(0, len(order), size):
        at = order[start : start + size]
        w, o = words[at], others[at]
        negative = np.searchsorted(chance, rng.random(SHARED) * chance[-1], side="right").clip(max=len(counts) - 1)
        v, c, n = vectors[w], context[o], context[negative]
        up = (rate * (1 - _sigmoid((v * c).sum(1))))[:, None]
        down = _sigmoid(v @ n.T) * (-rate * share)
        down[o[:, None] == negative] = 0  # a neighbour is no negative of its own pair
        _add(vectors, w, up * c + down @ n, LONGEST)
        _add(context, o, up * v, LONGEST)
        _add(context, negative, down.T @ v, LONGEST)


def _add(table: np.ndarray, at: np.ndarray, rows: np.ndarray, longest: float = np.inf) -> None:
    """Add rows at places that may repeat; a sum longer than ``longest`` is shortened to it."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.concatenate([[True], places[1:] != places[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    table[places[alone]] += _shortened(rows[order[alone]], longest)
    if not alone.all():
        places, order, starts = places[~alone], order[~alone], np.flatnonzero(first[~alone])
        table[places[starts]] += _shortened(np.add.reduceat(rows[order], starts, axis=0), longest)


def _shortened(steps: np.ndarray, longest: float) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", steps, steps))
    long = length > longest
    if long.any():
        steps[long] *= (longest / length[long])[:, None]
    return steps


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).astype(np.float32)


def spread_keys(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys that a shuffle into ``n`` partitions deals to one partition each; groups dealt by their number would
    share partitions by chance, and a step takes as long as its fullest one."""
    keys = spark.range(32 * n).select(F.col("id").cast("int").alias("key"))
    dealt = keys.repartition(n, "key").select("key", F.spark_partition_id().alias("at")).groupBy("at").agg(F.min("key").alias("key"))
    found = [r["key"] for r in dealt.orderBy("at").collect()]
    return found + [32 * n + i for i in range(n - len(found))]


def _step(blocks: DataFrame, pairs: DataFrame, step: int, n: int, rate: float, epoch: int, params: SkipGramParams,
          tasks: list[int]) -> DataFrame:
    """One step: blocks of words and of neighbours meet the pairs between them."""
    columns = ["grp", "kind", "block", "part", "a", "b", "c"]
    met = F.when(F.col("kind") == 0, F.col("block")).otherwise(F.pmod(F.col("block") - step, F.lit(n)))
    state = blocks.select(
        met.alias("grp"), "kind", "block", F.col("chunk").alias("part"), F.col("hashes").alias("a"), F.col("counts").alias("b"),
        F.col("weights").alias("c"),
    )
    own = pairs.where(F.col("step") == step).select(
        "grp", F.lit(2).alias("kind"), F.lit(-1).alias("block"), "part", F.col("words").alias("a"), F.col("others").alias("b"),
        F.lit(None).cast("binary").alias("c"),
    )

    def run(batches):
        group, rng, chunks, held = None, None, {}, {}

        def rows():
            for kind, (hashes, counts, weights) in (held or opened(chunks)).items():
                yield from _rows(kind, chunks[kind][0][0], hashes, counts, weights)

        def opened(chunks):
            return {kind: [np.concatenate(x) for x in list(zip(*own, strict=True))[1:]] for kind, own in chunks.items()}

        for batch in batches:
            for grp, kind, block, _, a, b, c in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if grp != group:
                    yield from rows()
                    group, chunks, held, rng = grp, {}, {}, np.random.default_rng([params.seed, epoch, step, grp])
                if kind < 2:  # the blocks come before the pairs
                    hashes = np.frombuffer(a, "<i8")
                    weights = np.frombuffer(c, "<f4").reshape(len(hashes), -1)
                    chunks.setdefault(kind, []).append((block, hashes, np.frombuffer(b, "<i8"), weights))
                    continue
                held = held or opened(chunks)
                if len(held) == 2:
                    words = _places(held[0][0], np.frombuffer(a, "<i8"))
                    others = _places(held[1][0], np.frombuffer(b, "<i8"))
                    known = (words >= 0) & (others >= 0)
                    train(held[0][2], held[1][2], held[1][1], words[known], others[known], rate, rng, params)
        yield from rows()

    rows = state.unionByName(own).withColumn("task", F.get(F.array(*map(F.lit, tasks)), F.col("grp"))).repartition(n, "task")
    return rows.select(columns).sortWithinPartitions("grp", "kind", "part").mapInArrow(run, BLOCKS)


def n_blocks(n_words: int, slots: int) -> int:
    return max(-(-n_words // MOST_WORDS), min(slots, -(-n_words // LEAST_WORDS)), 1)


def gathered(blocks: int, slots: int) -> int:
    """Blocks that are trained: an epoch moves all vectors once per block, so blocks beyond the slots are joined, up to
    ``GATHERED`` of them."""
    return max(-(-blocks // GATHERED), min(blocks, slots))


def skip_gram(df: DataFrame, tokens_col: str, params: SkipGramParams = SkipGramParams()) -> DataFrame:
    """``(word, vector)`` of every word that occurs ``min_count`` times; an empty table if there is none."""
    with shuffles_freed(df.sparkSession):  # a step's shuffle holds all vectors
        return _trained(df, tokens_col, params)


def _trained(df: DataFrame, tokens_col: str, params: SkipGramParams) -> DataFrame:
    spark = df.sparkSession
    docs = materialise(df.select(tokens_col), "skipgram-docs", even=True)
    counts = docs.select(F.explode(tokens_col).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = materialise(counts.where(F.col("n") >= params.min_count).withColumn("hash", F.xxhash64("word")), "words")
    n_words, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slots = spark.sparkContext.defaultParallelism
    n = params.blocks or gathered(n_blocks(n_words, slots), slots)
    keep = {}
    if params.sample:  # at most 1 / sample words have such a share
        frequent = settle(counts.where(F.col("n") > params.sample * total).select("hash", "n"))
        for r in frequent.collect():
            ratio = params.sample * total / r["n"]
            keep[r["hash"]] = ratio**0.5 + ratio
    vocabulary = counts.withColumn("block", F.pmod("hash", F.lit(n)).cast("int"))
    blocks = materialise(_first_blocks(vocabulary, params), "blocks", row_group=ROW_GROUP)
    pairs = _stored_pairs(_pair_groups(docs, tokens_col, keep, n, params))
    release(spark, docs)
    tasks = spread_keys(spark, n)
    for epoch in range(params.epochs):
        for step in range(n):
            done = (epoch * n + step) / (params.epochs * n)
            rate = params.learning_rate * max(1e-4, 1 - done)
            previous, blocks = blocks, materialise(
                _step(blocks, pairs, step, n, rate, epoch, params, tasks), "blocks", row_group=ROW_GROUP
            )
            release(spark, previous)
    release(spark, pairs)

    def vectors(batches):
        for batch in batches:
            for hashes, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(hashes, "<i8")
                w = np.frombuffer(weights, "<f4").astype(np.float64)
                for i in range(0, len(h), 4096):
                    part = h[i : i + 4096]
                    values = w.reshape(len(h), -1)[i : i + 4096]
                    lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * values.shape[1], values.reshape(-1))
                    yield pa.RecordBatch.from_arrays([pa.array(part), lists], ["hash", "v"])

    found = blocks.where("kind = 0").select("hashes", "weights").mapInArrow(vectors, "hash long, v array<double>")
    return counts.select("word", "hash").join(found, "hash").select("word", array_to_vector("v").alias("vector"))
