"""What the operators share: scratch tables, blocks of text, hashes."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes that a task turns into arrays at a time.
BLOCK_BYTES = 1 << 21
# Rows up to which an intermediate table may be broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 300_000
# Spark's switch that deletes the shuffle files of a query when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where it is unset, a session inside one process gets a folder of
    its own; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries run inside leave no shuffle files behind; the session's own setting comes back afterwards."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage ends here and a lost executor costs a
    read. Shuffle files of the write go with its end, the table when the session's JVM ends."""
    return written_parts(df.sparkSession, [df], name)


def written_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """The rows of all parts as one written table. A part is planned and written when the one before has ended and its
    shuffle files are gone, so that only one part's are there at a time."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    for df in parts:
        schema = df.schema
        with shuffles_freed(spark):
            df.write.mode("append").parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    table = spark.read.schema(schema).parquet(path)
    table.scratch_path = path
    return table


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    for table in tables:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table with a broadcast hint if its counted rows are few; else as it is, to be shuffled."""
    return F.broadcast(table) if table.count() <= max_rows else table


def spread(df: DataFrame) -> DataFrame:
    """A scan of few splits dealt to as many tasks as the session shuffles into, for work that is heavy per
    row; a scan of many splits stays as it is."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def crc_remainder(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def text_blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES):
    """Slices of the batches whose texts hold about ``limit`` bytes (a single longer text makes a slice)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64) + 64
        cum, start, n = np.cumsum(sizes), 0, batch.num_rows
        while start < n:
            base = cum[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(cum, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all (finaliser of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 1024), _BASE, dtype=np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ([^\\x20\\x09-\\x0D]+) of all texts, in order, and each text's number of
    words. ``lower`` maps A-Z to a-z first."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    inside = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    lengths = ends - starts
    where = np.flatnonzero(inside)
    first = np.cumsum(lengths) - lengths
    position = np.arange(len(where)) - np.repeat(first, lengths)
    value = _BYTE_VALUE[_LOWER[data[where]] if lower else data[where]]
    value *= powers(int(lengths.max()))[position]
    hashes = mixed(np.add.reduceat(value, first) + lengths.astype(np.uint64))
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_text))))
    return hashes, counts


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of the texts; null is empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)
