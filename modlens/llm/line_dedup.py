"""Line deduplication by a segment-partition edit join.

The lines of all documents (split at \\n) are compared. A line is dropped if an earlier line, by (doc_id, line
number), is equal to it or, where both have at least ``near_chars`` characters, at most ``edits`` edits away; the
first of equal lines is never dropped for them. Lines under ``min_chars`` characters say too little and stay.

Equal lines are one class from the start, by a 128-bit digest. For the others a line is cut into edits + 1 segments;
a line within that many edits contains one of them unchanged, shifted by few places. So each line has keys (length,
segment number, text of the segment) for its own segments and for those of its substrings that a line of its length
or of up to ``edits`` characters less could have there (only the positions that an alignment can reach). Lines
that share a key are verified with a banded bit-parallel edit distance.

Members of a key are first held against its earliest line; those that this does not drop are open. A key with few
open lines holds them against all its earlier ones. A key with more than HOT of them is a stretch that unlike lines have
in common. Its members get finer keys: of lines within the edits, some shared segment i has at most i edits before it and
at most ``edits`` - i behind. So the gaps on both sides of the shared segment are cut into pieces, about 8 a line, later
16, and a key is the segment and all pieces but that many in each gap. Lines must agree in most of their text to share
one. Keys of the last level hold their open lines against all earlier ones whatever their number: those lines agree in
about 14 of 16 pieces. No pair within the edits is lost at any level.

Edge cases: a null text stays null, an empty text has no line to drop; ties go by doc_id, then line number; rows
that repeat a doc_id count as one document, so they do not drop each other's equal lines of the same number;
other columns of the input are kept.
"""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, mixed, powers, signed, small, spread, text_blocks, written

# Candidates of one line that a task compares; more are dealt to further tasks.
PAIRS_PER_TASK = 5000
# Open lines of a key up to which they are held against all its earlier lines.
HOT = 16
# Pieces of a line at the finer levels.
FINER = (8, 16)
# Parts in which keys are counted, one after another, so that one part's shuffle files are there at a time.
PASSES = 4
# Shared keys (one long each) up to which they may be broadcast.
KEYS = 2_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE_BASE = pow(0xD6E8FEB86659FD93, -1, 1 << 64)


@cache
def _code_values() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * _STEP)


class _Inverse:
    """Powers of the inverse hash base, modulo 2^64."""

    values = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        if len(cls.values) < n:
            steps = np.full(n, np.uint64(_INVERSE_BASE), dtype=np.uint64)
            steps[0] = 1
            cls.values = np.multiply.accumulate(steps)
        return cls.values[:n]


@cache
def probes(length: int, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines of this length: start, end, indexed length and segment number of each key; the line's own
    segments come first."""
    out = []
    for shorter in range(edits + 1):
        indexed = length - shorter
        if indexed <= edits:
            continue
        ends = [indexed * (i + 1) // (edits + 1) for i in range(edits + 1)]
        starts = [0, *ends[:-1]]
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            low = max(0, a - i, a + shorter - (edits - i))
            high = min(length - (b - a), a + i, a + shorter + (edits - i))
            for start in range(low, high + 1):
                own = shorter == 0 and start == a
                out.append((not own, start, start + b - a, indexed, i))
    out.sort()
    columns = np.array(out, dtype=np.int64).reshape(-1, 5)
    return tuple(columns[:, k] for k in range(1, 5))


def gap_runs(indexed: int, length: int, edits: int, pieces: int) -> list[tuple[int, tuple, bool]]:
    """How a gap beside a shared segment may agree with that of an indexed line, at most ``edits`` edits away: the
    number of the pieces that may differ, the start and end of the edits + 1 runs between them, whether none is shifted.
    The first run starts with the gap and the last one ends with it."""
    if not edits:
        return [(0, ((0, length),), True)] if indexed == length else []
    cut, out = [indexed * i // pieces for i in range(pieces + 1)], []
    steps = [(0, *x, length - indexed) for x in product(range(-edits, edits + 1), repeat=edits - 1)]
    steps = [x for x in steps if sum(abs(q - p) for p, q in zip(x, x[1:])) <= edits]
    for number, gone in enumerate(combinations(range(pieces), edits)):
        first, last = (0, *(cut[g + 1] for g in gone)), (*(cut[g] for g in gone), indexed)
        for shifts in steps:
            runs = tuple((p + x, q + x) for p, q, x in zip(first, last, shifts, strict=True))
            if all(0 <= p and q <= length for p, q in runs):
                out.append((number, runs, not any(shifts)))
    return out


@cache
def finer_probes(
    length: int, slot: int, edits: int, pieces: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For lines of this length that share the key of this slot: starts and ends of the edits + 1 runs of each finer key,
    its tag, and whether it is one of the line's own. Segment i of the indexed line is shared where at most i edits lie
    before it and ``edits`` - i after it. A finer key is that segment and the pieces of both gaps but for that many."""
    start, end, indexed, segment = (int(x[slot]) for x in probes(length, edits))
    parts = edits + 1
    after = edits - segment
    cuts = [max(k + 1, -(-pieces * k // parts)) for k in (segment, after)]
    left = gap_runs(indexed * segment // parts, start, segment, cuts[0])
    right = gap_runs(indexed - indexed * (segment + 1) // parts, length - end, after, cuts[1])
    out: dict[tuple, bool] = {}
    for (i, before, plain), (j, behind, as_plain) in product(left, right):
        runs = [*before[:-1], (before[-1][0], end + behind[0][1]), *((end + p, end + q) for p, q in behind[1:])]
        runs = [(p, q) if p < q else (0, 0) for p, q in runs]
        key = (((indexed * 64 + segment) << 24) + i * comb(cuts[1], after) + j, *(p for p, _ in runs), *(q for _, q in runs))
        out[key] = out.get(key, False) or (slot <= edits and plain and as_plain)
    table = np.array(list(out), dtype=np.int64).reshape(-1, 2 * edits + 3)
    own = np.fromiter(out.values(), bool, len(out))
    return table[:, 1 : edits + 2], table[:, edits + 2 :], mixed(table[:, 0].astype(np.uint64) + _STEP), own


class _Hasher:
    """Hashes of stretches of lines that are put one after another."""

    def __init__(self, lines: list[str]):
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.cumsum(self.length) - self.length
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.value = _code_values()[codes]
        self.inverse = _Inverse.upto(len(codes) + 2)
        self.sums = self.summed(self.value)

    @staticmethod
    def summed(value: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(value) + 1, dtype=np.uint64)
        np.cumsum(value * powers(len(value) + 1)[: len(value)], out=sums[1:])
        return sums

    def __call__(self, start, end, sums=None):
        sums = self.sums if sums is None else sums
        return mixed((sums[end] - sums[start]) * self.inverse[start])


def by_length(length: np.ndarray):
    """Each length (or other number) and the indices of the lines that have it."""
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    return zip(sizes.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ()


def line_records(texts: list[str], min_chars: int, near_chars: int, edits: int):
    """Per line of at least min_chars: text index, line number, length, two digests, number of keys (0 below
    near_chars); then the keys of all lines."""
    lines = [t.split("\n") for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lines])
    number = np.concatenate([np.arange(len(x)) for x in lines]) if lines else np.zeros(0, np.int64)
    hashed = _Hasher([line for x in lines for line in x])
    kept = np.flatnonzero(hashed.length >= min_chars)
    length, start = hashed.length[kept], hashed.start[kept]
    d1 = hashed(start, start + length) + length.astype(np.uint64)
    # A second digest from another weighting of the characters.
    d2 = hashed(start, start + length, hashed.summed(mixed(hashed.value ^ _STEP)))
    near = np.flatnonzero(length >= near_chars)
    groups = [(size, near[rows]) for size, rows in by_length(length[near])]
    counts = np.zeros(len(kept), dtype=np.int64)
    for size, rows in groups:
        counts[rows] = len(probes(size, edits)[0])
    ends = np.cumsum(counts)
    keys = np.zeros(ends[-1] if len(ends) else 0, dtype=np.uint64)
    for size, rows in groups:
        a, b, indexed, segment = probes(size, edits)
        at, tag = start[rows][:, None], mixed((indexed * 64 + segment).astype(np.uint64) + _STEP)
        keys[(ends - counts)[rows][:, None] + np.arange(len(a))] = hashed(at + a, at + b) + tag
    return owner[kept], number[kept], length, signed(d1), signed(d2), counts, signed(keys)


def finer_keys(lines: list[str], edits: int, pieces: int, slots: np.ndarray | None = None):
    """Index of the line, key, and whether it is one of the line's own, for blocks of the lines; each line with the
    slot of the key that it shares, or with all slots."""
    salt = np.arange(1, edits + 2, dtype=np.uint64) * _STEP
    for low in range(0, len(lines), 1024):
        hashed = _Hasher(lines[low : low + 1024])
        for size, of_size in by_length(hashed.length):
            if slots is None:
                groups = [(slot, of_size) for slot in range(len(probes(size, edits)[0]))]
            else:
                groups = [(slot, of_size[among]) for slot, among in by_length(slots[low + of_size])]
            for slot, rows in groups:
                starts, ends, tag, own = finer_probes(size, slot, edits, pieces)
                at, total = hashed.start[rows][:, None], np.zeros((len(rows), len(tag)), dtype=np.uint64)
                for r in range(edits + 1):
                    total += mixed(hashed(at + starts[:, r], at + ends[:, r]) + salt[r])
                keys = mixed(total) + tag
                yield np.repeat(rows + low, len(tag)), signed(keys.ravel()), np.tile(own, len(rows))


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance if it is at most ``most``, else most + 1: bit-parallel over a band of 2 * most + 1 rows
    that moves along the diagonal."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start, end = 0, 0
    shared = min(len(a), len(b))
    while start < shared and a[start : start + 64] == b[start : start + 64]:
        start += 64
    start = min(start, shared)
    while start < shared and a[start] == b[start]:
        start += 1
    while end < shared - start and a[len(a) - 1 - end] == b[len(b) - 1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    m, n = len(a), len(b)
    if not m or not n:
        return min(max(m, n), most + 1)
    width = 2 * most + 1
    band = (1 << width) - 1
    # Bit d is row j - most + d of column j.
    up, down, distance = band & ~((1 << most) - 1), 0, min(most, m)
    for j in range(1, n + 1):
        equal, c = 0, b[j - 1]
        for row in range(max(1, j - most), min(m, j + most) + 1):
            if a[row - 1] == c:
                equal |= 1 << (row - j + most)
        zero = ((((equal & up) + up) ^ up) | equal | down) & band
        right = (down | ~(zero | up)) & band
        left = zero & up
        if j + most <= m:
            distance += not zero >> (2 * most) & 1
        else:
            bit = m - j + most
            distance += (right >> bit & 1) - (left >> bit & 1)
        if distance > 2 * most + abs(n - m):
            return most + 1
        zero >>= 1
        up = (left | ~(zero | right)) & band
        down = zero & right
    return min(distance, most + 1)


def line_table(docs: DataFrame, min_chars: int, near_chars: int, edits: int) -> DataFrame:
    """(doc_id, line, n, d1, d2, keys) of every line of at least min_chars."""

    def run(batches):
        for block in text_blocks(batches):
            ids = np.asarray(block.column(0).to_numpy(zero_copy_only=False))
            texts = ["" if t is None else t for t in block.column(1).to_pylist()]
            owner, number, length, d1, d2, counts, keys = line_records(texts, min_chars, near_chars, edits)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
            columns = [ids[owner], number.astype(np.int64), length, d1, d2]
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, columns), keys], ["doc_id", "line", "n", "d1", "d2", "keys"]
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return spread(slim).mapInArrow(run, "doc_id long, line long, n long, d1 long, d2 long, keys array<long>")


def near_lines(docs: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """Those of the pairs (a, b) of positions whose lines are at most ``edits`` edits apart."""
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("long").alias("n_tasks"))
    members = pairs.join(tasks, "a").select(
        "a", F.pmod(F.xxhash64("b"), "n_tasks").alias("task"), F.lit(1).alias("kind"), F.col("b").alias("at")
    )
    pivots = tasks.select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tasks") - 1)).alias("task"),
        F.lit(0).alias("kind"), F.col("a").alias("at"),
    )
    # The lines of a document that take part, with what they are wanted for, in lists of bounded length.
    wanted = members.union(pivots).select(
        F.col("at.doc_id").alias("doc_id"),
        F.pmod(F.xxhash64("a", "task", "at.line"), F.lit(16)).alias("part"),
        F.struct(F.col("at.line").alias("line"), "a", "task", "kind").alias("w"),
    )
    wanted = written(wanted.groupBy("doc_id", "part").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted, 100_000), "doc_id")

    def to_lines(batches):
        for block in text_blocks(batches):
            get = lambda name: block.column(block.schema.get_field_index(name)).to_pylist()
            rows = []
            for doc_id, text, wanted in zip(get("doc_id"), get("text"), get("wanted"), strict=True):
                lines = (text or "").split("\n")
                for w in wanted:
                    if w["line"] < len(lines):
                        rows.append(
                            (w["a"]["doc_id"], w["a"]["line"], w["task"], w["kind"], doc_id, w["line"], lines[w["line"]])
                        )
            names = ["a_doc", "a_line", "task", "kind", "b_doc", "b_line", "text"]
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 2 + [pa.string()]
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

    def verify(batches):
        pivot = None
        for batch in batches:
            out = []
            for a_doc, a_line, _, kind, b_doc, b_line, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    pivot = text
                elif edit_distance(pivot, text, edits) <= edits:
                    out.append((a_doc, a_line, b_doc, b_line))
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], ["a_doc", "a_line", "b_doc", "b_line"]
            )

    schema = "a_doc long, a_line long, task long, kind int, b_doc long, b_line long, text string"
    dealt = texts.mapInArrow(to_lines, schema).repartition("a_doc", "a_line", "task")
    dealt = dealt.sortWithinPartitions("a_doc", "a_line", "task", "kind")
    found = dealt.mapInArrow(verify, "a_doc long, a_line long, b_doc long, b_line long")
    position = lambda x: F.struct(F.col(f"{x}_doc").alias("doc_id"), F.col(f"{x}_line").alias("line"))
    found = written(found.select(position("a").alias("a"), position("b").alias("b")).distinct(), "near")
    drop(docs.sparkSession, wanted)
    return found


def finer_entries(docs: DataFrame, positions: DataFrame, edits: int, pieces: int) -> DataFrame:
    """(key, at, indexed, slot) of the lines at the positions ``at``, with finer keys inside the one that has the slot."""
    wanted = positions.groupBy(
        F.col("at.doc_id").alias("doc_id"), F.pmod(F.xxhash64("at.line"), F.lit(16)).alias("part")
    ).agg(F.collect_list(F.struct("at.line", "slot")).alias("wanted"))
    wanted = written(wanted, "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(wanted, 100_000), "doc_id")

    def run(batches):
        for block in text_blocks(batches):
            get = lambda name: block.column(block.schema.get_field_index(name)).to_pylist()
            ids, numbers, slots, lines = [], [], [], []
            for doc_id, text, wanted in zip(get("doc_id"), get("text"), get("wanted"), strict=True):
                split = (text or "").split("\n")
                inside = [w for w in wanted if w["line"] < len(split)]
                ids += [doc_id] * len(inside)
                numbers += [w["line"] for w in inside]
                slots += [w["slot"] for w in inside]
                lines += [split[n] for n in numbers[len(lines) :]]
            ids, numbers, slots = (np.array(x, dtype=np.int64) for x in (ids, numbers, slots))
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            # Rows that repeat an id may hold a line of another length there, without this slot.
            most = {n: len(probes(n, edits)[0]) for n in np.unique(sizes).tolist()}
            fits = np.flatnonzero([slot < most[n] for slot, n in zip(slots.tolist(), sizes.tolist(), strict=True)])
            ids, numbers, slots, lines = ids[fits], numbers[fits], slots[fits], [lines[i] for i in fits.tolist()]
            for rows, keys, own in finer_keys(lines, edits, pieces, slots):
                columns = [ids[rows], numbers[rows], keys, own, slots[rows]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["doc_id", "line", "key", "indexed", "slot"])

    found = texts.mapInArrow(run, "doc_id long, line long, key long, indexed boolean, slot long")
    return found.select("key", F.struct("doc_id", "line").alias("at"), "indexed", "slot").distinct()


def near_firsts(docs: DataFrame, entries: DataFrame, edits: int) -> DataFrame:
    """The positions ``at`` of entries (key, at, indexed, slot) whose line is near an earlier one that shares a key. The
    written table ``entries`` is deleted."""
    spark, decided = docs.sparkSession, []
    known = lambda: reduce(DataFrame.union, decided)
    for pieces in (*FINER, None):
        groups = entries.groupBy("key").agg(
            F.min("at").alias("lo"), F.max("at").alias("hi"), F.max("indexed").alias("useful")
        )
        groups = written(groups.where("useful and lo <> hi").select("key", "lo"), "groups")
        members = written(entries.join(small(groups), "key"), "members")
        later = members.where("at <> lo")
        if decided:
            later = later.join(known(), "at", "left_anti")
        pairs = written(later.select(F.col("lo").alias("a"), F.col("at").alias("b")).distinct(), "pairs")
        drop(spark, entries, groups)
        found = near_lines(docs, pairs, edits)
        decided.append(written(found.select(F.col("b").alias("at")).distinct(), "decided"))
        open_ = members.where("at <> lo").join(known(), "at", "left_anti")
        open_ = written(open_.select("key", F.col("at").alias("b"), F.col("indexed").alias("b_indexed")), "open")
        hot = open_.groupBy("key").agg(F.countDistinct("b").alias("n")).where(F.col("n") > HOT).select("key")
        hot = written(hot if pieces else hot.where("false"), "hot")
        earlier = members.select("key", F.col("at").alias("a"), F.col("indexed").alias("a_indexed"))
        rest = open_.join(small(hot), "key", "left_anti").join(earlier, "key").where("a < b and (a_indexed or b_indexed)")
        rest = written(rest.select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
        more = near_lines(docs, rest, edits)
        decided.append(written(more.select(F.col("b").alias("at")).distinct(), "decided"))
        done = not hot.limit(1).count()
        if not done:
            positions = members.join(small(hot), "key", "left_semi").select("at", "slot").distinct()
            entries = written(finer_entries(docs, positions, edits, pieces), "entries")
        drop(spark, members, pairs, found, open_, hot, rest, more)
        if done:
            break
    out = written(known().distinct(), "near_lines")
    drop(spark, *decided)
    return out


def dropped_lines(
    docs: DataFrame, min_chars: int = 20, near_chars: int = 40, edits: int = 2
) -> DataFrame:
    """(doc_id, line) of every line to drop, as a written table."""
    spark = docs.sparkSession
    lines = written(line_table(docs, min_chars, near_chars, edits), "lines")
    at = F.struct("doc_id", "line")
    same = ["d1", "d2", "n"]
    classes = written(lines.groupBy(*same).agg(F.min(at).alias("first"), F.count("*").alias("copies")), "classes")
    # Keys that unlike lines share. Only these are carried on with the lines that have them.
    parts = []
    for part in range(PASSES):
        keys = lines.select("d1", F.posexplode("keys").alias("slot", "key")).where(F.pmod("key", F.lit(PASSES)) == part)
        shared = keys.groupBy("key").agg(
            F.min("d1").alias("lo"), F.max("d1").alias("hi"), F.max((F.col("slot") <= edits).cast("int")).alias("useful")
        )
        parts.append(written(shared.where("lo <> hi and useful = 1").select("key"), "shared"))
    shared = reduce(DataFrame.union, parts)
    # Written before copies are left out: Spark would do that on all keys of all lines, before the join with the shared.
    met = lines.select(*same, at.alias("first"), F.posexplode("keys").alias("slot", "key")).join(small(shared, KEYS), "key")
    met = written(met, "met")
    entries = met.join(classes.select(*same, "first"), [*same, "first"], "left_semi")
    slot = F.col("slot").cast("long")
    entries = entries.select("key", F.col("first").alias("at"), (slot <= edits).alias("indexed"), slot.alias("slot"))
    entries = written(entries, "entries")
    drop(spark, met, *parts)
    near = near_firsts(docs, entries, edits)
    firsts = near.select(F.col("at").alias("first"), F.lit(True).alias("near"))
    bad = written(classes.join(firsts, "first", "left").where("near or copies > 1"), "bad")
    out = lines.select("doc_id", "line", *same).join(small(bad), same)
    out = written(out.where("near or struct(doc_id, line) <> first").select("doc_id", "line"), "repeated")
    drop(spark, lines, classes, near, bad)
    return out


def line_dedup(docs: DataFrame, min_chars: int = 20, near_chars: int = 40, edits: int = 2) -> DataFrame:
    """The documents with shortened texts and two more columns, n_lines (non-blank lines before) and n_dropped."""
    dropped = dropped_lines(docs, min_chars, near_chars, edits)
    lists = written(dropped.groupBy("doc_id").agg(F.collect_set("line").alias("__dropped")), "dropped")
    drop(docs.sparkSession, dropped)
    ids = docs.withColumn("__line_id", F.col("doc_id").cast("long"))
    joined = ids.join(small(lists).select(F.col("doc_id").alias("__line_id"), "__dropped"), "__line_id", "left").drop("__line_id")
    fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_lines long, n_dropped long"])

    def run(batches):
        for block in text_blocks(batches):
            get = lambda name: block.column(block.schema.get_field_index(name))
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(get("text").to_pylist(), get("__dropped").to_pylist(), strict=True):
                lines, gone = (text or "").split("\n"), set(gone or ())
                n_lines.append(sum(1 for x in lines if x and not x.isspace()))
                n_dropped.append(len(gone))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            columns = [pa.array(texts, pa.string()) if f.name == "text" else get(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                [*(f.name for f in fields), "n_lines", "n_dropped"],
            )

    return joined.mapInArrow(run, schema)
