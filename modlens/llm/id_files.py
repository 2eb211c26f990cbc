"""Token ids of documents in compressed segments, written and read by Spark.

Documents are dealt to tasks by ranges of doc_id and sorted; every task encodes its texts and writes segments. A
segment is a byte string of its own: magic and version, number of documents, number of blocks, crc32 of the
directory; the directory (ids of the documents with a flag for null, ids per document, bytes per block); the blocks
of ``id_coder``. A segment ends with a document once it holds ``SEGMENT`` ids, so a task holds one segment and one
document at most. Segments lie in the rows of a Parquet table, since Spark's writers reach every store:
part (the task), segment (its number there), before (ids of the task before it), n_ids, data.

Reading sums the ids of the parts that come before (one number a part), then decodes each segment where it is read:
no shuffle of ids, and a lost executor costs the segments it was reading.

Edge cases: null and empty texts are documents of the end id alone; rows that repeat a doc_id are documents of
their own, ordered by a hash of their text, so one id may be split over tasks; null ids come first; an empty table
gives an empty one; the strings of special tokens in a text become what the tokenizer makes of them; further
columns are ignored. A byte that was changed after writing makes the read fail.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import id_coder
from .common import small, text_blocks
from .packing import encoder

MAGIC = b"CMR1"
HEAD = struct.Struct("<4sIII")
SEGMENT = id_coder.BLOCK * id_coder.LANES
SEGMENTS = "part long, segment long, before long, n_ids long, data binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_segment(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """Bytes of documents, given as arrays of ids."""
    ids = np.concatenate(documents)
    blocks = id_coder.encode([ids[i : i + id_coder.BLOCK] for i in range(0, len(ids), id_coder.BLOCK)])
    directory = b"".join((
        np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(),
        np.array([i is None for i in doc_ids], dtype="u1").tobytes(),
        np.array([len(d) for d in documents], dtype="<u8").tobytes(),
        np.array([len(b) for b in blocks], dtype="<u4").tobytes(),
    ))
    return HEAD.pack(MAGIC, len(documents), len(blocks), zlib.crc32(directory)) + directory + b"".join(blocks)


def _directory(data: bytes) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    magic, n, n_blocks, crc = HEAD.unpack_from(data)
    end = HEAD.size + 17 * n + 4 * n_blocks
    if magic != MAGIC or zlib.crc32(memoryview(data)[HEAD.size : end]) != crc:
        raise ValueError("damaged segment: its directory does not match its checksum")
    doc_ids = np.frombuffer(data, "<i8", n, HEAD.size).tolist()
    null = np.frombuffer(data, "u1", n, HEAD.size + 8 * n)
    for i in np.flatnonzero(null):
        doc_ids[i] = None
    lengths = np.frombuffer(data, "<u8", n, HEAD.size + 9 * n).astype(np.int64)
    cuts = end + np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u4", n_blocks, HEAD.size + 17 * n).astype(np.int64))])
    if cuts[-1] != len(data):
        raise ValueError("damaged segment: it has another length than its directory states")
    return doc_ids, lengths, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def unpack_segments(segments: list[bytes]) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """Document ids, ids per document and all ids of each segment; their blocks are decoded side by side."""
    found = [_directory(data) for data in segments]
    blocks = id_coder.decode([b for _, _, own in found for b in own])
    at = 0
    for doc_ids, lengths, own in found:
        yield doc_ids, lengths, np.concatenate(blocks[at : at + len(own)])
        at += len(own)


def write_ids(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Segments of the documents' ids, each document closed by ``end_id``. Write the result before reading it."""

    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, number, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, documents, size = [], [], 0

        def segment() -> pa.RecordBatch:
            data = pack_segment(doc_ids, documents)
            values = ([part], [number], [before], [size])
            columns = [*(pa.array(v, pa.int64()) for v in values), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SEGMENTS.split(", ")])

        for block in text_blocks(batches):
            for doc_id, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(enc.encode(text or "") + end, dtype="<u4")
                doc_ids.append(doc_id)
                documents.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield segment()
                    number, before = number + 1, before + size
                    doc_ids, documents, size = [], [], 0
        if size:
            yield segment()

    # Rows of one id are spread by a hash of their text; equal rows by any number, as they are alike.
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("_hash", F.xxhash64("text"))
        .withColumn("_any", F.monotonically_increasing_id() % 1024)
        .repartitionByRange("doc_id", "_hash", "_any")
        .sortWithinPartitions("doc_id", "_hash", "text")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(run, SEGMENTS)


def read_ids(table: DataFrame) -> DataFrame:
    """A row per document of written segments: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, all from the decoded ids."""
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    sums = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("first"))

    def run(batches):
        waiting, size = [], 0
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            for start, n, data in rows:
                waiting.append((start, data))
                size += n
                if size >= SEGMENT:
                    yield documents(waiting)
                    waiting, size = [], 0
        if waiting:
            yield documents(waiting)

    def documents(segments: list[tuple[int, bytes]]) -> pa.RecordBatch:
        doc_ids, starts, counts, crcs = [], [], [], []
        decoded = unpack_segments([data for _, data in segments])
        for (start, _), (own, lengths, ids) in zip(segments, decoded, strict=True):
            ends = np.cumsum(lengths)
            ids = np.ascontiguousarray(ids, dtype="<u4")
            doc_ids += own
            starts.append(start + ends - lengths)
            counts.append(lengths)
            crcs += [zlib.crc32(ids[b - n : b]) for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
        columns = [
            pa.array(doc_ids, pa.int64()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(counts)),
            pa.array(crcs, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DOCUMENTS.split(", ")])

    placed = table.join(small(first), "part").select((F.col("first") + F.col("before")).alias("start"), "n_ids", "data")
    return placed.mapInArrow(run, DOCUMENTS)
