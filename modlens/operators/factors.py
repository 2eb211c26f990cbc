"""Implicit alternating least squares on blocks of rows (Hu, Koren and Volinsky, 2008).

The same steps as Spark's ``ALS`` with ``implicitPrefs``, from the same starting factors, solved exactly. Rows are dealt to
blocks by their number; a task meets the entries of its rows and the other side's factors that they name, so neither table
of factors is ever whole on the driver. A row of few entries is solved in as many unknowns as it has entries (the matrix
inversion lemma over the eigenvectors of the shared part), a longer one in as many as a factor has.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlens.sources.tables import materialise, release, scratch_folder, shuffles_freed

REGULARISATION = 0.1  # times the entries of a row; the confidence of an entry is 1 + its rating
FEW = 40  # entries up to which a row is solved in them
BATCH_BYTES = 1 << 25
SLICE = 1 << 16  # entries of one row taken at a time
BLOCK_ENTRIES = 1 << 24
SOLVED = "id int, x array<float>, targets array<int>"


def _flat(column: pa.ChunkedArray, dtype) -> np.ndarray:
    parts = [pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate([np.zeros(0, dtype), *parts]).astype(dtype, copy=False)


def _solve_few(x, at, c, gram, n: int) -> np.ndarray:
    """Rows of n entries each: ``at`` and ``c`` are (rows, n)."""
    scale, turn = np.linalg.eigh(gram)
    inverse = 1.0 / (np.maximum(scale, 0.0) + REGULARISATION * n)
    v = x[at].astype(float) @ turn
    inner = c[:, :, None] * ((v * inverse) @ v.transpose(0, 2, 1)) + np.eye(n)
    z = np.linalg.solve(inner, (1.0 + c)[:, :, None])
    return ((v.transpose(0, 2, 1) @ z)[:, :, 0] * inverse) @ turn.T


def _equation(x, at, c, gram) -> tuple[np.ndarray, np.ndarray]:
    a = gram + REGULARISATION * len(at) * np.eye(len(gram))
    b = np.zeros(len(gram))
    for i in range(0, len(at), SLICE):
        y, w = x[at[i : i + SLICE]].astype(float), c[i : i + SLICE]
        half = y * np.sqrt(w)[:, None]
        a += half.T @ half
        b += y.T @ (1.0 + w)
    return a, b


def solve_rows(x: np.ndarray, at: np.ndarray, c: np.ndarray, sizes: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Factors of rows whose entries follow each other in ``at`` (places in ``x``) and ``c`` (ratings)."""
    rank, first = len(gram), np.cumsum(sizes) - sizes
    out = np.zeros((len(sizes), rank))
    for n in np.unique(sizes[(sizes > 0) & (sizes <= FEW)]):
        rows = np.flatnonzero(sizes == n)
        step = max(1, BATCH_BYTES // (8 * int(n) * (rank + int(n))))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            entries = first[some][:, None] + np.arange(n)
            out[some] = _solve_few(x, at[entries], c[entries], gram, int(n))
    many = np.flatnonzero(sizes > FEW)
    step = max(1, BATCH_BYTES // (8 * rank * rank))
    for i in range(0, len(many), step):
        some = many[i : i + step]
        pairs = [_equation(x, at[f : f + s], c[f : f + s], gram) for f, s in zip(first[some], sizes[some], strict=True)]
        out[some] = np.linalg.solve(np.stack([a for a, _ in pairs]), np.stack([b for _, b in pairs])[:, :, None])[:, :, 0]
    return out


def _solver(rank: int, gram: np.ndarray) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def solve(factors: pa.Table, rows: pa.Table) -> pa.Table:
        ids = factors["id"].to_numpy()
        order = np.argsort(ids)
        x = _flat(factors["x"], np.float32).reshape(-1, rank)
        sizes = pc.list_value_length(rows["others"]).to_numpy()
        at = order[np.searchsorted(ids, _flat(rows["others"], np.int32), sorter=order)]
        found = solve_rows(x, at, _flat(rows["ratings"], np.float32).astype(float), sizes, gram).astype(np.float32)
        offsets = np.arange(len(sizes) + 1, dtype=np.int32) * rank
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))
        return pa.table({"id": rows["id"], "x": column, "targets": rows["targets"]})

    return solve


def _gram(factors: DataFrame, rank: int) -> np.ndarray:
    """Sum of the outer products of all factors; a task returns one matrix."""

    def products(batches):
        total = np.zeros((rank, rank))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, rank).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = factors.select("x").mapInArrow(products, "m binary").collect()
    return sum((np.frombuffer(p["m"]).reshape(rank, rank) for p in parts), np.zeros((rank, rank)))


def _rows(ratings: DataFrame, own: str, other: str, blocks: int) -> DataFrame:
    """``(block, id, others, ratings, targets)``: a row's entries, and the blocks that need its factor."""
    entries = F.collect_list(F.struct(F.col(other).alias("o"), F.col("rating").alias("r")))
    grouped = ratings.groupBy(F.col(own).alias("id")).agg(entries.alias("e"))
    targets = F.array_distinct(F.transform("e.o", lambda o: o % blocks))
    return materialise(grouped.select(
        (F.col("id") % blocks).alias("block"), "id", F.col("e.o").alias("others"), F.col("e.r").alias("ratings"), targets.alias("targets")
    ), f"{own}-rows")


def item_factors(ratings: DataFrame, rank: int, epochs: int, seed: int, blocks: int | None = None) -> DataFrame:
    """``(id, features)`` of the items of positive ``(user int, item int, rating)``; numbers start at zero."""
    spark = ratings.sparkSession
    ratings = materialise(ratings.select("user", "item", F.col("rating").cast("float").alias("rating")), "ratings")
    # No sweep: the factors that the method starts from. It checkpoints to the shared folder.
    spark.sparkContext.setCheckpointDir(scratch_folder(spark))
    start = ALS(
        rank=rank, maxIter=0, implicitPrefs=True, seed=seed, userCol="user", itemCol="item", ratingCol="rating"
    ).fit(ratings)
    if not epochs:
        return start.itemFactors
    if blocks is None:
        blocks = max(2 * spark.sparkContext.defaultParallelism, ratings.count() // BLOCK_ENTRIES)
    with shuffles_freed(spark):
        sides = [_rows(ratings, "item", "user", blocks), _rows(ratings, "user", "item", blocks)]
        release(spark, ratings)
        first = start.userFactors.select("id", F.col("features").alias("x"))
        factors = materialise(first.join(sides[1].select("id", "targets"), "id"), "user-factors")
        for step in range(2 * epochs - 1):  # the last users are of no use to the items
            messages = factors.select(F.explode("targets").alias("block"), "id", "x")
            pairs = messages.groupBy("block").cogroup(sides[step % 2].groupBy("block"))
            solved = materialise(pairs.applyInArrow(_solver(rank, _gram(factors, rank)), SOLVED), "factors")
            release(spark, factors)
            factors = solved
    for side in sides:
        release(spark, side)
    return factors.select("id", F.col("x").alias("features"))
