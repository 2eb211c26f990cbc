"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct word n-grams (64-bit hashes; a text with fewer words is one n-gram, one
without words has no set). Sets of about equal size form a band; two sets of Jaccard similarity t or more lie in
one band or in neighbouring ones, and the size of their difference is at most k = (1-t)/(1+t) * (sum of sizes).
The feature domain is cut into n1 partitions, and these into n2 parts each, by the n-gram's hash. With at most k
differences some partition has at most k2 = k // n1 of them, so among the subsets of n2 - k2 of its parts one is
equal in both sets: the hash of such a subset is a signature, and every pair that must link shares one.

Equal sets are one class from the start. Candidates of a signature are held against its smallest member p, so a
group of thousands of copies costs one comparison each. Links among the others are only sought where components
differ, and by what sets differ in from p: let D(x) be the difference of x and p, so that the difference of x and y
is that of D(x) and D(y). With c = (1-t)/(1+t), sets link if they differ in at most c * (sum of sizes) elements. If x
is not linked with p but with y, D(x) and D(y) share more than (1-c)/2 * |D(y)| elements, and all but k of D(x). By
prefix filtering they share one among the first k + 1 elements of D(x) and the first |D(y)| - (1-c)/2 * |D(y)| of D(y)
(k + 1, if y is not linked with p either), in any order that is the same for all members of p. Tasks take elements that
p lacks before those it has, so only such prefixes are stored. Where many members share such elements (a second
passage, say), the prefixes of that pivot's members are taken again with the rarest elements first. Copies that were
each edited at other places share none, and no pair of them is ever made. All comparisons are exact on whole sets.

Edge cases: null, empty and blank texts have size 0 and link with nothing, not even with each other; rows that
repeat a doc_id count as copies of each other if their text is equal; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import as_bytes, drop, mixed, signed, small, spread, text_blocks, word_hashes, written, written_parts
from .components import components

_STEP = np.uint64(0x9E3779B97F4A7C15)
# Candidates of one pivot that a task compares; more are dealt to further tasks.
PAIRS_PER_TASK = 2000
# Pairs a member may add, on average, before its pivot's elements are ordered by rarity.
PAIRS_PER_MEMBER = 16
# Parts in which signatures and elements are counted, one after another, so that one part's shuffle files are there at a time.
PASSES = 4
# Documents up to which all signatures are counted at once; those of more are counted in up to PASSES parts.
DOCS_PER_PASS = 25_000
# Pairs up to which all texts travel at once; of more, the pivots are compared in up to PASSES parts.
PAIRS_PER_PASS = 100_000


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text."""
    words, counts = word_hashes(texts)
    grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
    for i in range(n):
        grams *= _STEP
        grams += words[i : i + len(grams)] if len(grams) else grams
    grams = mixed(grams)
    start = 0
    for count in counts.tolist():
        if count >= n:
            yield np.unique(grams[start : start + count - n + 1])
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for w in words[start : start + count]:
                    whole = whole * _STEP + w
            yield mixed(np.array([whole]))
        else:
            yield np.zeros(0, dtype=np.uint64)
        start += count


class PartEnum:
    """Bands and signatures for Jaccard similarity ``percent``/100 or more."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        self._plans: dict[int, tuple[int, int, int]] = {}

    def band(self, size: int) -> int:
        """Band b holds the sizes edges[b] .. edges[b+1]-1; a partner of a set lies at most one band away."""
        while self.edges[-1] <= size:
            self._grow()
        return int(np.searchsorted(self.edges, size, side="right")) - 1

    def _grow(self) -> None:
        low = self.edges[-1]
        self.edges.append(max(low + 1, (low - 1) * 100 // self.percent + 1))

    def differences(self, group: int) -> int:
        """Most differences of a linked pair from bands group-1 and group."""
        while len(self.edges) <= group + 1:
            self._grow()
        largest = self.edges[group + 1] - 1
        return int(Fraction(100 - self.percent, 100 + self.percent) * 2 * largest)

    def plan(self, k: int) -> tuple[int, int, int]:
        """(n1, n2, k2): few differences enumerate subsets of one partition, many use a partition for each."""
        if k not in self._plans:
            self._plans[k] = (1, k + 2, k) if k <= 4 else (k + 1 + self.spare(k), 1, 0)
            n1, n2, k2 = self._plans[k]
            assert k // n1 <= k2 < n2 and comb(n2, k2) <= 15
        return self._plans[k]

    @staticmethod
    def spare(k: int) -> int:
        """Partitions beyond k + 1. Of n1 partitions, spare + 1 are equal in two sets that link, so a set with at
        most ``spare`` empty ones shares one that is not empty, and needs no signature for its empty ones."""
        return 1 + k // 15

    def signatures(self, features: np.ndarray) -> np.ndarray:
        """Signatures of one set, for the groups of its own band and of the next."""
        if not len(features):
            return features
        own, spread_bits, out = self.band(len(features)), mixed(features ^ _STEP), []
        for group in (own, own + 1):
            k = self.differences(group)
            if k == 0:  # only equal sets link, and these are one class already
                continue
            n1, n2, k2 = self.plan(k)
            sums = np.zeros(n1 * n2, dtype=np.uint64)
            part = (spread_bits >> np.uint64(20)) % np.uint64(n1 * n2)
            np.add.at(sums, part, features)
            if k2:
                subsets = list(combinations(range(n2), n2 - k2))
                sums = np.array([mixed(sums[list(s)]).sum(dtype=np.uint64) for s in subsets])
            tag = np.arange(len(sums), dtype=np.uint64) + np.uint64(group << 32)
            found = mixed(sums + mixed(tag + np.uint64(1)))
            if not k2:
                filled = np.bincount(part.astype(np.int64), minlength=n1) > 0
                found = found[filled] if n1 - filled.sum() <= self.spare(k) else found
            out.append(found)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


@cache
def _part_enum(percent: int) -> PartEnum:
    return PartEnum(percent)


def described(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, s0, s1, ...): size, 128-bit digest and signatures of each document's set, these in
    ``PASSES`` columns by their value, so that each part is read alone."""
    names = [f"s{part}" for part in range(PASSES)]

    def run(batches):
        enum = _part_enum(percent)
        for block in text_blocks(batches):
            sizes, digests, found = [], [], []
            for features in shingle_sets(as_bytes(block.column(1)), n):
                sizes.append(len(features))
                digests.append((features.sum(dtype=np.uint64), mixed(features + _STEP).sum(dtype=np.uint64)))
                found.append(enum.signatures(features))
            digests = signed(np.array(digests, dtype=np.uint64).reshape(-1, 2))
            flat = np.concatenate([np.zeros(0, np.uint64), *found])
            owner, part = np.repeat(np.arange(len(found)), [len(x) for x in found]), flat % np.uint64(PASSES)
            lists = []
            for k in range(PASSES):
                ends = np.cumsum(np.bincount(owner[part == k], minlength=len(found)))
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat[part == k]))))
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(sizes, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), *lists],
                ["doc_id", "n_shingles", "d1", "d2", *names],
            )

    schema = ", ".join(["doc_id long, n_shingles long, d1 long, d2 long", *(f"{c} array<long>" for c in names)])
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, schema)


def prefix(pivot: np.ndarray, own: np.ndarray, linked: bool, percent: int, whole: bool) -> tuple[int, int, np.ndarray]:
    """How many elements two sets differ in, how many of them the pivot lacks, and the first of all: those that the
    pivot lacks come before those it has, each by value. ``whole`` gives all that the pivot lacks."""
    extra, missing = (np.setdiff1d(x, y, assume_unique=True) for x, y in ((own, pivot), (pivot, own)))
    apart, least, most = len(extra) + len(missing), 100 - percent, 100 + percent
    if linked:
        take = apart - apart * percent // most
    else:  # differences of linked sets, if the other is as large as it can be
        take = least * (len(own) + len(own) * 100 // percent) // most + 1
    return apart, len(extra), np.concatenate([extra if whole else extra[:take], missing[: max(0, take - len(extra))]])


def compared(docs: DataFrame, pairs: DataFrame, n: int, percent: int, elements: str = "prefix") -> DataFrame:
    """The pairs (a, b) with their sizes, whether they link, in how many elements they differ, and these elements: the
    ``prefix`` that can decide, with ``all`` that the pivot lacks, or ``none``. A pivot ``a`` with many partners is compared in several tasks, each
    with its own copy of the pivot's set. A pivot with one partner has no elements: there is no other to link with."""
    def compared_part(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        tasks = pairs.groupBy("a").agg(
            F.ceil(F.count("*") / PAIRS_PER_TASK).cast("long").alias("n_tasks"),
            F.when((F.count("*") > 1) & F.lit(elements != "none"), 1).otherwise(2).alias("kind"),
        )
        members = pairs.join(tasks, "a").select(
            "a", F.pmod(F.xxhash64("b"), "n_tasks").alias("task"), F.col("b").alias("id"), "kind"
        )
        pivots = tasks.select(
            "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tasks") - 1)).alias("task"),
            F.col("a").alias("id"), F.lit(0).alias("kind"),
        )
        wanted = written(members.unionByName(pivots), "wanted")
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(small(wanted), "id")
        # Texts travel, since they are smaller than the hashes of their n-grams.
        dealt = texts.select("a", "task", "kind", "id", "text").repartition("a", "task")
        done = dealt.sortWithinPartitions("a", "task", "kind").mapInArrow(
            verify, "a long, b long, sa long, sb long, linked boolean, apart long, extra long, differ array<long>"
        )
        return done, wanted

    def verify(batches):
        pivot, at = None, None
        for block in text_blocks(batches):
            a, task, kind, ids = (block.column(i).to_numpy() for i in range(4))
            rows, differ = [], []
            for i, own in enumerate(shingle_sets(as_bytes(block.column(4)), n)):
                if kind[i] == 0:
                    pivot, at = own, (a[i], task[i])
                    continue
                assert at == (a[i], task[i])
                shared = len(np.intersect1d(pivot, own, assume_unique=True))
                linked = 100 * shared >= percent * (len(pivot) + len(own) - shared)
                apart, extra, first = len(pivot) + len(own) - 2 * shared, len(own) - shared, own[:0]
                if kind[i] == 1:
                    apart, extra, first = prefix(pivot, own, linked, percent, elements == "all")
                rows.append((a[i], ids[i], len(pivot), len(own), linked, apart, extra))
                differ.append(first)
            ends = np.concatenate(([0], np.cumsum([len(x) for x in differ]))).astype(np.int32)
            flat = signed(np.concatenate(differ)) if differ else np.zeros(0, np.int64)
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array([x for x in c], t) for c, t in zip(columns, kinds, strict=True)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                ["a", "b", "sa", "sb", "linked", "apart", "extra", "differ"],
            )

    def parts():
        passes = min(PASSES, 1 + pairs.count() // PAIRS_PER_PASS)
        for part in range(passes):
            done, wanted = compared_part(pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == part))
            yield done
            drop(docs.sparkSession, wanted)

    return written_parts(docs.sparkSession, parts(), "compared")


def _shared_elements(carried: DataFrame) -> DataFrame:
    """(a, e, n, far): elements that a pivot's members share, one of them not linked with it; a written table."""
    parts = []
    for part in range(PASSES):
        elements = carried.select("a", "linked", F.explode("differ").alias("e")).where(F.pmod("e", F.lit(PASSES)) == part)
        counted = elements.groupBy("a", "e").agg(F.count("*").alias("n"), F.count(F.when(~F.col("linked"), 1)).alias("far"))
        parts.append(written(counted.where("n > 1 and far > 0"), "part"))
    found = written(reduce(DataFrame.union, parts), "common")
    drop(carried.sparkSession, *parts)
    return found


def _rarest_first(docs: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """Probes (a, b, e, rank) of the members of these pairs. Elements that the pivot lacks come first, the rarest of them
    before others; then those it has, by value."""
    stars = compared(docs, pairs, n, percent, "all")
    common = _shared_elements(stars)
    elements = stars.select("a", "b", "extra", F.posexplode("differ").alias("at", "e")).join(small(common), ["a", "e"])
    lacked = F.col("at") < F.col("extra")
    member = W.partitionBy("a", "b", lacked)
    among = F.row_number().over(member.orderBy("n", "e"))
    # What no other member has counts before what is shared.
    rank = F.when(lacked, F.col("extra") - F.count("*").over(member) + among).otherwise(F.col("at") + 1)
    probes = written(elements.select("a", "b", "e", rank.alias("rank")), "rarest")
    drop(docs.sparkSession, stars, common)
    return probes


def across_components(docs: DataFrame, stars: DataFrame, found: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can still link, from what they differ in from a pivot. The table
    ``stars`` is deleted as soon as its elements are unfolded."""
    spark = docs.sparkSession
    own = found.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    pivot = found.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    labelled = stars.select("a", "b").join(own, "b", "left").join(pivot, "a", "left").select(
        "a", "b", F.coalesce("cb", "b").alias("component"), F.coalesce("ca", "a").alias("ca")
    )
    labelled = written(labelled, "labelled")
    mixed_pivots = written(labelled.where("component <> ca").select("a").distinct(), "mixed")
    # Only members of these pivots carry their elements on.
    named = written(labelled.join(small(mixed_pivots), "a").select("a", "b", "component"), "named")
    least, most = 100 - percent, 100 + percent
    carried = stars.where("size(differ) > 0").join(small(named), ["a", "b"])
    members = written(
        carried.select(
            "a", "b", "sb", "component", (~F.col("linked")).alias("far"), F.col("apart").alias("n"),
            F.expr(
                f"if(linked, apart - floor(apart * {percent} / {most}),"
                f" floor({least} * (sb + floor(sb * 100 / {percent})) / {most}) + 1)"
            ).alias("take"),
        ),
        "members",
    )
    common = _shared_elements(carried)
    sizes = members.groupBy("a").agg(F.count("*").alias("members"))
    heavy = common.groupBy("a").agg(F.sum(F.col("n").cast("double") * F.col("far")).alias("pairs")).join(sizes, "a")
    heavy = written(heavy.where(F.col("pairs") > PAIRS_PER_MEMBER * F.col("members")).select("a"), "heavy")
    elements = carried.join(small(heavy), "a", "left_anti").select("a", "b", F.posexplode("differ").alias("at", "e"))
    elements = elements.join(small(common.select("a", "e")), ["a", "e"], "left_semi")
    probes = written(elements.select("a", "b", "e", (F.col("at") + 1).alias("rank")), "first")
    drop(spark, stars, labelled, mixed_pivots, named, common)
    rarest = [probes]
    if heavy.limit(1).count():
        again = written(members.join(small(heavy), "a", "left_semi").select("a", "b"), "again")
        rarest.append(_rarest_first(docs, again, n, percent))
        drop(spark, again)
        probes = probes.unionByName(rarest[1])
    probes = probes.join(members, ["a", "b"]).where("rank <= take").select(
        "a", "e", "b", "sb", "component", "far", "n", (F.col("n") - F.col("rank")).alias("rest")
    )
    probes = written(probes, "probes")
    drop(spark, heavy, members, *rarest)
    side = lambda t, b, x: t.select(
        "a", "e", F.col("b").alias(b), *(F.col(c).alias(f"{c}_{x}") for c in ("sb", "component", "n", "rest"))
    )
    # What both must share at least, against what their first common element leaves to share.
    most_apart = f"floor({least} * (sb_x + sb_y) / {most})"
    pairs = (
        side(probes.where("far"), "x", "x").join(side(probes, "y", "y"), ["a", "e"])
        .where("x <> y and component_x <> component_y")
        .where(f"n_x + n_y - 2 * (1 + least(rest_x, rest_y)) <= {most_apart}")
        .where(f"100 * least(sb_x, sb_y) >= {percent} * greatest(sb_x, sb_y)")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )
    pairs = written(pairs, "across")
    drop(spark, probes)
    return pairs


def _stars(base: DataFrame, copies: DataFrame) -> Iterator[DataFrame]:
    """Pairs (a, b) of the smallest document of a signature and each other one, a part of the signatures at a time: all of
    them are many times the documents, in tasks and in shuffles."""
    keys = ["d1", "d2", "n_shingles"]
    left_out, passes = small(copies), min(PASSES, 1 + base.count() // DOCS_PER_PASS)
    for part in range(passes):
        own = F.concat(*(f"s{k}" for k in range(part, PASSES, passes)))
        one = base.select("doc_id", *keys, own.alias("signatures")).where("size(signatures) > 0")
        entries = one.join(left_out, ["doc_id", *keys], "left_anti").select(
            F.explode("signatures").alias("sig"), F.col("doc_id").alias("b")
        )
        shared = entries.groupBy("sig").agg(F.count("*").alias("n"), F.min("b").alias("lo"), F.max("b").alias("hi"))
        shared = written(shared.where("n > 1"), "shared")
        many = written(shared.where("n > 2").select("sig", F.col("lo").alias("a")), "many")
        yield (
            shared.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
            .union(entries.join(small(many), "sig").select("a", "b"))
            .where("a <> b")
            .distinct()
        )
        drop(base.sparkSession, shared, many)


def jaccard_join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable over links of
    Jaccard similarity percent/100 or more on word n-grams)."""
    base = written(described(docs, n, percent), "sets")
    classes = base.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    keys = ["d1", "d2", "n_shingles"]
    # Copies of a smaller id: their signatures are those of the representative.
    copies = written(
        base.select("doc_id", *keys).join(classes, keys).where("doc_id <> rep").select("doc_id", *keys).distinct(), "copies"
    )
    stars = written_parts(docs.sparkSession, _stars(base, copies), "stars")
    pairs = written(stars.distinct(), "pairs")
    members = written(base.select("doc_id", *keys), "members")
    drop(docs.sparkSession, base, copies, stars)
    stars = compared(docs, pairs, n, percent)
    links = written(stars.where("linked").select("a", "b"), "links")
    found = components(links)
    across = across_components(docs, stars, found, n, percent)
    drop(docs.sparkSession, pairs, found)
    more = compared(docs, across, n, percent, "none")
    found = components(links.union(more.where("linked").select("a", "b")))
    reps = classes.join(found, classes["rep"] == found["id"], "left").select(
        *keys, F.coalesce("component", "rep").alias("component")
    )
    result = members.join(reps, keys, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )
    result = written(result, "joined")
    drop(docs.sparkSession, members, classes, links, more, across, found)
    return result


def one_per_group(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """The documents without the near copies of another: of each component the smallest doc_id stays.

    Of rows that repeat an id and a text one stays (its other columns are those of any of them); rows that share an id
    but not their text stay or go together. A row without an id cannot be named by a component: such rows stay, one of
    each text.
    """
    known = docs.where("doc_id IS NOT NULL")
    kept = written(jaccard_join(known, n, percent).where("doc_id = component_id").select("doc_id").distinct(), "kept")
    again = written(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    stay, repeated = known.join(kept, "doc_id", "left_semi"), small(again)
    # Only rows of repeated or missing ids are grouped; the key holds the text, so that missing ids are not one group.
    several = stay.join(repeated, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).dropDuplicates(["doc_id", "text"])
    return stay.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(several.select(docs.columns))
