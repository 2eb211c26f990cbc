"""Exact k nearest neighbours as a partitioned join (after Lu, Shen, Chen and Ooi, 2012).

Candidates fall into the cell of their nearest pivot.  A query visits only the cells that the
triangle inequality cannot rule out: its distance to the (k+1)-th nearest pivot bounds the answer,
because pivots are candidates themselves.  Cells are cut into blocks of bounded size on both sides,
so a cell with most of the rows becomes many tasks; each block returns at most k rows per query.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modlens.operators.ranking import random_key

BLOCK_ROWS = 4096
ROWS_PER_PIVOT = 20_000
MAX_PIVOTS = 256
SQUARES = 1 << 21  # of a matrix product at a time
PAIRS = 1 << 14  # of plain differences at a time
GROUP = 32


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between rows, from plain differences (no cancellation)."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        d = b - row
        out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def _nearest_one(query: np.ndarray, matrix: np.ndarray, own: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    delta = matrix - query
    d = np.sqrt(np.einsum("ij,ij->i", delta, delta))
    d[own] = np.inf
    best = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    best = best[np.argsort(d[best], kind="stable")][:k]
    best = best[np.isfinite(d[best])]
    return best, d[best]


def nearest_rows(queries: np.ndarray, matrix: np.ndarray, query_ids, ids, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query's place, candidate's place and distance of the k nearest candidates of another id; ties to the earlier place.

    A matrix product finds the candidates that its rounding error cannot rule out; only these get their distance from
    plain differences. Where squares are not finite, all do.
    """
    places: dict = {}
    for i, v in enumerate(ids.tolist()):
        places.setdefault(v, []).append(i)
    own = [places.get(v, []) for v in query_ids.tolist()]
    rows, ats, dists = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    with np.errstate(over="ignore", invalid="ignore"):
        length = np.einsum("ij,ij->i", matrix, matrix)
        of_query = np.einsum("ij,ij->i", queries, queries)
        error = 32 * (matrix.shape[1] + 8) * np.finfo(float).eps * (np.sqrt(of_query) + np.sqrt(length.max())) ** 2
    usual = np.isfinite(error) & (len(matrix) > k)
    step = max(1, SQUARES // len(matrix))
    for start in range(0, len(queries), step):
        part = np.arange(start, min(start + step, len(queries)))
        for i in part[~usual[part]]:
            at, d = _nearest_one(queries[i], matrix, own[i], k)
            rows.append(np.full(len(at), i)), ats.append(at), dists.append(d)
        part = part[usual[part]]
        if not len(part):
            continue
        near = length - 2.0 * (queries[part] @ matrix.T)  # squares less the query's own length
        for j, i in enumerate(part):
            near[j, own[i]] = np.inf
        groups = len(matrix) // GROUP  # the k-th smallest of the groups' least is no less than the k-th smallest of all
        least = near[:, : groups * GROUP].reshape(len(part), GROUP, groups).min(axis=1) if groups > 4 * k else near
        limit = np.partition(least, k - 1, axis=1)[:, k - 1] + error[part]
        row, at = np.nonzero((near <= limit[:, None]) & (near < np.inf))
        d = np.empty(len(row))
        for i in range(0, len(row), PAIRS):  # of many equal rows all may be left
            delta = matrix[at[i : i + PAIRS]] - queries[part[row[i : i + PAIRS]]]
            d[i : i + PAIRS] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
        order = np.lexsort((at, d, row))
        row, at, d = row[order], at[order], d[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        rows.append(part[row[kept]]), ats.append(at[kept]), dists.append(d[kept])
    return np.concatenate(rows), np.concatenate(ats), np.concatenate(dists)


def knn(
    queries: DataFrame,
    candidates: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "x",
    pivots: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, neighbour_id, dist)`` for the k nearest other candidates of each query.

    Ties go to the smaller id.  Vectors are ``array<double>``.
    """
    id_type = candidates.schema[id_col].dataType
    queries = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("qx"))
    candidates = candidates.select(F.col(id_col).alias("cand_id"), F.col(vec_col).alias("cx"))
    if pivots is None:
        n = candidates.count()
        pivots = 1 if n <= 2 * ROWS_PER_PIVOT else min(MAX_PIVOTS, max(2 * (k + 1), n // ROWS_PER_PIVOT))
    chosen = candidates.orderBy(random_key("cand_id", "pivot"), "cand_id").limit(pivots).collect()
    output = T.StructType(
        [
            T.StructField("query_id", id_type),
            T.StructField("neighbour_id", id_type),
            T.StructField("dist", T.DoubleType()),
        ]
    )
    if not chosen:
        empty = queries.sparkSession.createDataFrame([], output)
        return empty.withColumn("rank", F.lit(0)).select("query_id", "rank", "neighbour_id", "dist")
    centres = np.array([r["cx"] for r in chosen], dtype=float)

    @F.pandas_udf("cell int, radius double")
    def nearest(x: pd.Series) -> pd.DataFrame:
        d = _distances(np.stack(x.to_numpy()), centres)
        cell = d.argmin(axis=1)
        return pd.DataFrame({"cell": cell.astype("int32"), "radius": d[np.arange(len(d)), cell]})

    placed = candidates.withColumn("at", nearest("cx")).select("cand_id", "cx", "at.cell", "at.radius")
    cells = (
        placed.groupBy("cell")
        .agg(F.count("*").alias("n"), F.min("radius").alias("near"), F.max("radius").alias("far"))
        .toPandas()
    )
    number, near, far = (cells[c].to_numpy() for c in ("cell", "near", "far"))

    @F.pandas_udf("array<int>")
    def reachable(x: pd.Series) -> pd.Series:
        d = _distances(np.stack(x.to_numpy()), centres)
        bound = np.full(len(d), np.inf)
        if d.shape[1] > k:
            bound = np.partition(d, k, axis=1)[:, k]
        to_cell = d[:, number]
        lower = np.maximum(to_cell - far, near - to_cell)
        open_ = lower <= bound[:, None] + 1e-9
        return pd.Series([number[row].astype("int32").tolist() for row in open_])

    visits = queries.withColumn("cell", F.explode(reachable("qx")))
    blocks_c = {int(c): ceil(n / block_rows) for c, n in zip(cells["cell"], cells["n"], strict=True)}
    per_cell = visits.groupBy("cell").agg(F.count("*").alias("m")).toPandas()
    blocks_q = {int(c): ceil(m / block_rows) for c, m in zip(per_cell["cell"], per_cell["m"], strict=True)}

    def lookup(table: dict[int, int]):
        return F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), F.col("cell"))

    if not blocks_q:
        blocks_q = {-1: 1}
    n_c, n_q = lookup(blocks_c), F.coalesce(F.try_element_at(
        F.create_map(*[F.lit(v) for kv in blocks_q.items() for v in kv]), F.col("cell")), F.lit(0))
    left = visits.select(
        "query_id", "qx", "cell",
        F.pmod(F.hash("query_id"), n_q).alias("qb"),
        F.explode(F.sequence(F.lit(0), n_c - 1)).alias("cb"),
    )
    right = placed.filter(n_q > 0).select(
        "cand_id", "cx", "cell",
        F.explode(F.sequence(F.lit(0), n_q - 1)).alias("qb"),
        F.pmod(F.hash("cand_id"), n_c).alias("cb"),
    )

    def block(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "neighbour_id": [], "dist": []})
        c = c.sort_values("cand_id")
        ids, own = c["cand_id"].to_numpy(), q["query_id"].to_numpy()
        row, at, dist = nearest_rows(np.stack(q["qx"].to_numpy()), np.stack(c["cx"].to_numpy()), own, ids, k)
        return pd.DataFrame({"query_id": own[row], "neighbour_id": ids[at], "dist": dist})

    keys = ["cell", "qb", "cb"]
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(block, output)
    order = Window.partitionBy("query_id").orderBy("dist", "neighbour_id")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "neighbour_id", "dist")
    )
