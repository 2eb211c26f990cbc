"""Audit of how sources of a language differ in their terms, by exact recount over perfect hashes.

First pass: each language keeps the terms that occur in at least ``min_docs`` of its documents, counted exactly (a
task sums what its documents hold before the shuffle). The kept terms are cut into shards by a hash; every shard of
about ``SHARD`` terms gets a minimal perfect hash (hash, displace): a pilot per bucket moves the bucket's terms to
free slots until no slot is left. A shard stores its terms in slot order.

Second pass: the documents are read again, a task counts terms per group and looks them up: pilot, slot, and then
the stored term is compared, so a term that is not kept never counts. Up to ``BROADCAST`` bytes the shards are
broadcast; beyond, the counted terms are shuffled to their shard. The hits increment dense slots, one array per
group and shard, merged over tasks in two steps so that a large group is split.

Then everything is arithmetic on dense integer arrays: p of each term in each group, and per shard the divergence
of all pairs of sources of a language (tiles of at most ``SOURCES``) and the terms that a group has most in excess.

Edge cases: null text, language and source are ''; rows that repeat an id are documents of their own; a group
without kept terms has its `pair` rows alone (value 0 if its language keeps no term); a language with one source has
no `pair` rows; an empty table gives an empty result; ties are ordered by the item's UTF-8 bytes; further columns are
ignored. Values stay below 2^63 for up to 10^8 kept terms a language and 9 * 10^15 counted terms a group.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, mixed, text_blocks, word_hashes, written

# Terms of a shard, bytes of shards that may be broadcast, sources of a tile.
SHARD, BROADCAST, SOURCES = 1 << 14, 32 << 20, 64
# Distinct terms that a task counts before it passes them on; tasks whose counts are merged first.
HELD, MERGED = 400_000, 1024
TERMS = re.compile(rb"[A-Za-z\x80-\xff]+").findall
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def hashes(terms: list[bytes]) -> np.ndarray:
    return word_hashes([b" ".join(terms)], lower=False)[0] if terms else np.zeros(0, np.uint64)


class PerfectHash:
    """A minimal perfect hash of terms with the terms themselves in slot order."""

    def __init__(self, seed: int, pilots: np.ndarray, terms: bytes, n: int):
        self.seed, self.pilots, self.n = np.uint64(seed), pilots, n
        self.terms = np.frombuffer(terms, dtype=np.uint8)
        ends = np.flatnonzero(self.terms == 32)
        self.starts = np.concatenate([[0], ends + 1])[:n]
        self.lengths = np.concatenate([ends, [len(terms)]])[:n] - self.starts

    @staticmethod
    def build(terms: list[bytes]) -> tuple[int, np.ndarray, bytes]:
        """Seed, pilots and terms in slot order, joined by spaces."""
        h, n = hashes(terms), len(terms)
        if len(np.unique(h)) < n:
            raise ValueError("two terms share their 64-bit hash")
        for seed in range(100):
            pilots = _pilots(h, np.uint64(seed), n)
            if pilots is not None:
                order = np.argsort(_slots(h, pilots, np.uint64(seed), n))
                return seed, pilots, b" ".join([terms[i] for i in order.tolist()])
        raise ValueError("no perfect hash found")

    def slots(self, terms: list[bytes], h: np.ndarray) -> np.ndarray:
        """Slot of each term, -1 for terms that are not stored."""
        slot = _slots(h, self.pilots, self.seed, self.n)
        length = np.fromiter(map(len, terms), dtype=np.int64, count=len(terms))
        same = self.lengths[slot] == length
        # compare the bytes of those that have the stored length
        at = np.flatnonzero(same)
        sizes = length[at]
        own = np.frombuffer(b"".join([terms[i] for i in at.tolist()]), dtype=np.uint8)
        first = np.cumsum(sizes) - sizes
        stored = np.repeat(self.starts[slot[at]] - first, sizes) + np.arange(len(own))
        different = np.zeros(len(own) + 1, dtype=np.int64)
        np.cumsum(own != self.terms[stored], out=different[1:])
        same[at] = different[first + sizes] == different[first]
        return np.where(same, slot, -1)


def _buckets(h: np.ndarray, seed: np.uint64, n_buckets: int) -> np.ndarray:
    return (mixed(h + (seed + np.uint64(1)) * GOLDEN) % np.uint64(n_buckets)).astype(np.int64)


def _displaced(h: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
    return (mixed(h ^ mixed(pilot.astype(np.uint64) * GOLDEN + np.uint64(1))) % np.uint64(n)).astype(np.int64)


def _slots(h: np.ndarray, pilots: np.ndarray, seed: np.uint64, n: int) -> np.ndarray:
    return _displaced(h, pilots[_buckets(h, seed, len(pilots))], n)


def _pilots(h: np.ndarray, seed: np.uint64, n: int, most: int = 1 << 20) -> np.ndarray | None:
    """A pilot per bucket, large buckets first; None if a bucket finds none."""
    n_buckets = max(1, n // 3)
    bucket = _buckets(h, seed, n_buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=n_buckets)
    starts = np.cumsum(sizes) - sizes
    pilots, taken = np.zeros(n_buckets, dtype=np.uint32), np.zeros(n, dtype=bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        own = h[order[starts[b] : starts[b] + sizes[b]]]
        if not len(own):
            break
        pilot, step = 0, 16
        while True:
            tried = np.arange(pilot, pilot + step, dtype=np.uint64)
            slot = _displaced(own[None, :], tried[:, None], n)
            free = ~taken[slot].any(axis=1)
            if len(own) > 1:
                ascending = np.sort(slot, axis=1)
                free &= (ascending[:, 1:] != ascending[:, :-1]).all(axis=1)
            good = np.flatnonzero(free)
            if len(good):
                pilots[b] = pilot + good[0]
                taken[slot[good[0]]] = True
                break
            pilot, step = pilot + step, min(step * 4, 1 << 14)
            if pilot > most:
                return None
    return pilots


def shard_of(h: np.ndarray, n_shards: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(n_shards)).astype(np.int64)


def _columns(names: str, *values) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(v, kinds[t]) for v, (_, t) in zip(values, fields, strict=True)], [n for n, _ in fields]
    )


DF = "lang string, term string, df long"


def _document_frequencies(batches):
    counted: dict[str, Counter] = defaultdict(Counter)

    def rows():
        for lang, own in counted.items():
            for i in range(0, len(keys := list(own)), 50_000):
                part = keys[i : i + 50_000]
                yield _columns(DF, [lang] * len(part), [t.decode() for t in part], [own[t] for t in part])
        counted.clear()

    for block in text_blocks(batches):
        for text, lang in zip(as_bytes(block.column(0)), block.column(1).to_pylist(), strict=True):
            counted[lang].update(set(TERMS(text.translate(LOWER))))
        if sum(map(len, counted.values())) > HELD:
            yield from rows()
    yield from rows()


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term) of the terms in at least so many documents of their language."""
    found = docs.select("text", "lang").mapInArrow(_document_frequencies, DF)
    return found.groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= min_docs).select("lang", "term")


HASHES = "lang string, shard long, n long, seed long, pilots binary, terms binary"


def perfect_hashes(kept: DataFrame, n_shards: int) -> DataFrame:
    """A perfect hash for each language and shard."""

    def place(batches):
        for batch in batches:
            shards = shard_of(hashes(as_bytes(batch.column(1))), n_shards)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards)], ["lang", "term", "shard"])

    def build(table: pa.Table) -> pa.Table:
        seed, pilots, terms = PerfectHash.build(as_bytes(table["term"].combine_chunks()))
        head = table.slice(0, 1)
        row = _columns(
            HASHES, head["lang"].to_pylist(), head["shard"].to_pylist(), [table.num_rows], [seed],
            [pilots.astype("<u4").tobytes()], [terms],
        )
        return pa.Table.from_batches([row])

    placed = kept.mapInArrow(place, "lang string, term string, shard long")
    return placed.groupBy("lang", "shard").applyInArrow(build, HASHES)


COUNTED = "lang string, source string, shard long, salt long, slots binary, counts binary"
WORDS = "lang string, source string, shard long, salt long, words binary, counts binary"


def _sparse(slots: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    return slots.astype("<u4").tobytes(), counts.astype("<i8").tobytes()


def _opened(seed: int, pilots: bytes, terms: bytes, n: int) -> PerfectHash:
    return PerfectHash(seed, np.frombuffer(pilots, dtype="<u4"), terms, n)


def _counted_terms(batches, n_shards: int):
    """(lang, source, shard, terms, hashes, counts) of what a task's documents hold, group by group."""
    counted: dict[tuple[str, str], Counter] = defaultdict(Counter)

    def found():
        for (lang, source), own in counted.items():
            terms, h = list(own), hashes(list(own))
            counts = np.fromiter(own.values(), dtype=np.int64, count=len(own))
            shard = shard_of(h, n_shards)
            order = np.argsort(shard, kind="stable")
            ends = np.cumsum(np.bincount(shard, minlength=n_shards))
            for s in range(n_shards):
                at = order[ends[s - 1] if s else 0 : ends[s]]
                if len(at):
                    yield lang, source, s, [terms[i] for i in at.tolist()], h[at], counts[at]
        counted.clear()

    for block in text_blocks(batches):
        texts = as_bytes(block.column(0))
        rows: dict[tuple[str, str], list[bytes]] = defaultdict(list)
        for text, group in zip(texts, zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True), strict=True):
            rows[group].append(text)
        for group, own in rows.items():
            counted[group].update(TERMS(b"\n".join(own).translate(LOWER)))
        if sum(map(len, counted.values())) > HELD:
            yield from found()
    yield from found()


def recount(docs: DataFrame, hashes_table: DataFrame, n_shards: int, n_bytes: int, limit: int) -> DataFrame:
    """Counts of the kept terms by group and shard, one row per task at least, as (slots, counts)."""
    columns = docs.select("text", "lang", "source")
    salt = lambda: TaskContext.get().partitionId() // MERGED
    if n_bytes <= limit:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in hashes_table.collect()])

        def look_up(batches):
            stored = {(r[0], r[1]): _opened(r[3], r[4], r[5], r[2]) for r in shared.value}
            out = []
            for lang, source, s, terms, h, counts in _counted_terms(batches, n_shards):
                if (lang, s) in stored:
                    slots = stored[lang, s].slots(terms, h)
                    hit = slots >= 0
                    out.append((lang, source, s, salt(), *_sparse(slots[hit], counts[hit])))
                if len(out) == 256:
                    yield _columns(COUNTED, *zip(*out, strict=True))
                    out = []
            if out:
                yield _columns(COUNTED, *zip(*out, strict=True))

        return columns.mapInArrow(look_up, COUNTED)

    def words(batches):
        for lang, source, s, terms, _, counts in _counted_terms(batches, n_shards):
            row = [lang], [source], [s], [salt()], [b" ".join(terms)], [counts.astype("<i8").tobytes()]
            yield _columns(WORDS, *row)

    def look_up_shuffled(batches):
        key, stored = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["source"] is None:  # the perfect hash comes before the terms of its shard
                    key = row["lang"], row["shard"]
                    stored = _opened(row["seed"], row["pilots"], row["words"], row["n"])
                elif (row["lang"], row["shard"]) == key:
                    terms = row["words"].split(b" ")
                    slots, hit = stored.slots(terms, hashes(terms)), None
                    hit = slots >= 0
                    sparse = _sparse(slots[hit], np.frombuffer(row["counts"], dtype="<i8")[hit])
                    values = row["lang"], row["source"], row["shard"], row["salt"], *sparse
                    yield _columns(COUNTED, *[[v] for v in values])

    stored = hashes_table.withColumnRenamed("terms", "words")
    both = columns.mapInArrow(words, WORDS).unionByName(stored, allowMissingColumns=True)
    dealt = both.repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("source").asc_nulls_first())
    return dealt.mapInArrow(look_up_shuffled, COUNTED)


def merged(counted: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys added up in dense slots, while the sorted rows stream by."""
    names = ", ".join(f"{k} {'long' if k in ('shard', 'salt') else 'string'}" for k in keys)
    schema = f"{names}, slots binary, counts binary, total long"

    def run(batches):
        key, dense = None, np.zeros(0, dtype=np.int64)

        def row():
            slots = np.flatnonzero(dense)
            return _columns(schema, *[[k] for k in key], *[[x] for x in _sparse(slots, dense[slots])], [int(dense.sum())])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for *own, slots, counts in zip(*columns, strict=True):
                if own != key:
                    if key is not None:
                        yield row()
                    key, dense = own, np.zeros(SHARD, dtype=np.int64)
                slots, counts = np.frombuffer(slots, dtype="<u4"), np.frombuffer(counts, dtype="<i8")
                if len(slots) and int(slots.max()) >= len(dense):
                    dense = np.concatenate([dense, np.zeros(int(slots.max()) + 1 - len(dense), dtype=np.int64)])
                dense[slots] += counts  # a row has a slot once
        if key is not None:
            yield row()

    dealt = counted.select(*keys, "slots", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def shares(counts: np.ndarray, total: int, n_terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + n_terms)), by long division in steps of a thousand."""
    rest, quotient, whole = counts + 1, np.zeros_like(counts), np.int64(total + n_terms)
    # the first digits: count + 1 <= total + n_terms, so the quotient below starts at 0 or 1
    quotient, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        quotient, rest = quotient * 1000 + rest // whole, rest % whole
    return quotient + 1


def _dense(slots: bytes, counts: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=np.int64)
    out[np.frombuffer(slots, dtype="<u4")] = np.frombuffer(counts, dtype="<i8")
    return out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


ITEMS = "lang string, source string, item string, value long"
TILES = "lang string, shard long, block long, part long, sources array<string>, p binary"


def _tiles(rows: DataFrame) -> DataFrame:
    """Shares of up to SOURCES sources of a language in a shard; the sorted rows stream by."""
    fields = [pa.field("lang", pa.string()), pa.field("shard", pa.int64()), pa.field("block", pa.int64()),
              pa.field("part", pa.int64()), pa.field("sources", pa.list_(pa.string())), pa.field("p", pa.binary())]

    def run(batches):
        key, part, names, p = None, 0, [], []

        def tile():
            values = [key[0]], [key[1]], [key[2]], [part], [names], [b"".join(p)]
            columns = [pa.array(v, f.type) for v, f in zip(values, fields, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

        for batch in batches:
            for r in batch.to_pylist():
                own = r["lang"], r["shard"], r["block"]
                if names and (own != key or len(names) == SOURCES):
                    yield tile()
                    part, names, p = part + 1 if own == key else 0, [], []
                key = own
                names.append(r["source"])
                p.append(shares(_dense(r["slots"], r["counts"], r["n"]), r["group_total"], r["n_terms"]).tobytes())
        if names:
            yield tile()

    dealt = rows.repartition("lang", "shard", "block").sortWithinPartitions("lang", "shard", "block", "source")
    return dealt.mapInArrow(run, TILES)


def _pair_values(batches):
    for batch in batches:
        for r in batch.to_pylist():
            left = np.frombuffer(r["p"], dtype="<i8").reshape(len(r["sources"]), -1)
            right = np.frombuffer(r["q"], dtype="<i8").reshape(len(r["others"]), -1)
            sources, items, values = [], [], []
            for source, p in zip(r["sources"], left, strict=True):
                sources += [source] * len(right)
                items += r["others"]
                values += [int(excess(p, q).sum()) for q in right]
            yield _columns(ITEMS, [r["lang"]] * len(items), sources, items, values)


def divergence(docs: DataFrame, min_docs: int = 3, top: int = 200, broadcast_bytes: int = BROADCAST) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` has every other source of the language, `term` the ``top``
    terms that the group has in excess of its language."""
    text = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = written(kept_terms(text, min_docs), "kept")
    languages = written(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum(F.octet_length("term") + 4).alias("b")), "langs")
    most, n_bytes = languages.agg(F.max("n_terms"), F.sum("b")).first()
    n_shards = max(1, -(-(most or 0) // SHARD))
    stored = written(perfect_hashes(kept, n_shards), "hashes")
    counted = recount(text, stored, n_shards, n_bytes or 0, broadcast_bytes)
    merged_once = merged(counted, "lang", "source", "shard", "salt")
    counts = written(merged(merged_once, "lang", "source", "shard"), "counts")
    in_language = written(merged(counts, "lang", "shard"), "language_counts")

    groups = written(text.select("lang", "source").distinct(), "groups")
    totals = counts.groupBy("lang", "source").agg(F.sum("total").alias("group_total"))
    known = groups.join(totals, ["lang", "source"], "left").join(languages.select("lang", "n_terms"), "lang")
    known = written(known.withColumn("group_total", F.coalesce("group_total", F.lit(0))), "totals")
    # every group has a row in every shard of its language, if an empty one
    n_blocks = -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // SOURCES) or 1
    nothing = F.lit(b"").cast("binary")
    full = known.join(stored.select("lang", "shard", "n"), "lang").join(
        counts.drop("total"), ["lang", "source", "shard"], "left"
    )
    full = full.withColumns({
        "slots": F.coalesce("slots", nothing), "counts": F.coalesce("counts", nothing),
        "block": F.pmod(F.xxhash64("source"), F.lit(n_blocks)).cast("long"),
    })
    tiles = written(_tiles(full), "tiles")
    others = tiles.select("lang", "shard", F.col("sources").alias("others"), F.col("p").alias("q"))
    values = tiles.join(others, ["lang", "shard"]).select("lang", "sources", "p", "others", "q")
    values = values.mapInArrow(_pair_values, ITEMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").where("source <> item").join(values, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    def terms_in_excess(batches):
        for batch in batches:
            for r in batch.to_pylist():
                slots = np.frombuffer(r["slots"], dtype="<u4")
                every = _dense(r["lang_slots"], r["lang_counts"], r["n"])[slots]
                p = shares(np.frombuffer(r["counts"], dtype="<i8"), r["group_total"], r["n_terms"])
                q = shares(every, r["lang_total"], r["n_terms"])
                over = np.flatnonzero(p > q)
                value = excess(p[over], q[over])
                if len(over) > top:  # ties at the cut stay until the terms order them
                    floor = np.partition(value, len(value) - top)[len(value) - top]
                    over, value = over[value >= floor], value[value >= floor]
                names = r["terms"].split(b" ")
                best = sorted(zip((-value).tolist(), (names[s] for s in slots[over].tolist()), strict=True))[:top]
                n = len(best)
                yield _columns(ITEMS, [r["lang"]] * n, [r["source"]] * n, [t.decode() for _, t in best], [-v for v, _ in best])

    lang_totals = in_language.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    of_language = in_language.select(
        "lang", "shard", F.col("slots").alias("lang_slots"), F.col("counts").alias("lang_counts")
    ).join(stored.select("lang", "shard", "n", "terms"), ["lang", "shard"])
    terms = (
        counts.drop("total").join(known, ["lang", "source"]).join(lang_totals, "lang").join(of_language, ["lang", "shard"])
        .mapInArrow(terms_in_excess, ITEMS)
        .select("lang", "source", F.lit("term").alias("part"), "item", "value")
    )
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).unionByName(ranked)


def divergence_sql(min_docs: int = 3, top: int = 200) -> str:
    letters = "abcdefghijklmnopqrstuvwxyz"
    share = "1 + (1000000000::HUGEINT * (n + 1)) // (total + v)"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{letters.upper()}', '{letters}'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {min_docs}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
a AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, v, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), p AS (SELECT lang, source, term, n, {share} AS p FROM a),
b AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total, any_value(v) AS v FROM a GROUP BY lang, term),
q AS (SELECT lang, term, {share} AS q FROM b),
values_of AS (
  SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3
), parts AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN values_of z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM parts
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR r <= {top}
"""
