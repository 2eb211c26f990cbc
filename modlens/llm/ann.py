"""Approximate nearest neighbours with balanced posting lists.

A bounded sample of the distinct vectors is cut into balanced clusters; their centroids are linked to a graph that
each task holds in memory and walks from a few entry points to find the centroids near a vector. Every vector is
indexed: it joins the posting list of its nearest centroid, and being near a boundary also those of further centroids
up to ``BOUNDARY`` times as far (at most ``REPLICAS`` lists), unless it is nearly the same as a centroid chosen before. A query
reads the lists whose centroids are at most ``PRUNE`` times as far as its nearest one (at least ``LEAST_LISTS``, at
most ``MOST_LISTS``), and distances are computed exactly, in double precision, on the original vectors.

Equal vectors are one entry: only the smallest ``k + 1`` of their ids can be among the k nearest of anything, so a
vector that a third of all rows share costs no more than another. Long lists are dealt to several tasks.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of
another dimension than the most frequent one of the sample neither; ties go to the smaller vec_id; a query has
fewer than k rows if there are fewer candidates; null ids take no part; rows that repeat an id count once if
their vectors are equal; other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import spread, written

LIST_SIZE = 96  # vectors per list that the number of lists aims at
MAX_LISTS = 4096
SAMPLE = 40_000
DEGREE, BEAM = 24, 24
BOUNDARY, REPLICAS, APART = 1.15, 6, 0.1
PRUNE, LEAST_LISTS, MOST_LISTS = 1.12, 24, 128
# Entries of a list that one task compares; longer lists are dealt to several.
BLOCK = 8192


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    return rows.where("vec_id is not null and size(v) > 0").where(
        ~F.exists("v", bad) & F.exists("v", lambda x: x != 0)
    )


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def balanced_centroids(x: np.ndarray, n_lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of clusters of equal size (up to one): each cut is at the median along the direction between
    the two means of a short 2-means."""
    out, todo = [], [(x, n_lists)]
    while todo:
        part, n = todo.pop()
        if n <= 1 or len(part) < 2:
            out.append(part.mean(0))
            continue
        ends = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(4):
            nearer = ((part - ends[0]) ** 2).sum(1) <= ((part - ends[1]) ** 2).sum(1)
            if nearer.all() or not nearer.any():
                break
            ends = np.array([part[nearer].mean(0), part[~nearer].mean(0)])
        along = part @ (ends[1] - ends[0])
        left = n // 2
        order = np.argsort(along, kind="stable")
        cut = round(len(part) * left / n)
        todo += [(part[order[cut:]], n - left), (part[order[:cut]], left)]
    return np.array(out)


class CentroidGraph:
    """Centroids linked to near ones in different directions; best-first search for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        n, degree = len(centroids), min(DEGREE, len(centroids) - 1)
        self.norm = (centroids**2).sum(1)
        links = np.zeros((n, max(degree, 1)), dtype=np.int32)
        for start in range(0, n, 512):
            rows = slice(start, min(n, start + 512))
            d = self.norm[None, :] - 2 * centroids[rows] @ centroids.T
            d[np.arange(d.shape[0]), np.arange(rows.start, rows.stop)] = np.inf
            near = np.argsort(d, axis=1)[:, : 3 * degree]
            for i, found in enumerate(near):
                own, kept = start + i, []
                between = ((centroids[found][:, None] - centroids[found][None]) ** 2).sum(2)
                to_own = ((centroids[found] - centroids[own]) ** 2).sum(1)
                for j in range(len(found)):
                    if len(kept) == degree:
                        break
                    if all(between[j, k] >= 0.8 * to_own[j] for k in kept):
                        kept.append(j)
                spare = [j for j in range(len(found)) if j not in kept]
                kept = (kept + spare)[: max(degree - 1, 0)]
                # The order of the clusters is a path through all, so every centroid can be reached.
                links[own, : len(kept) + 1] = [*(found[j] for j in kept), (own + 1) % n]
                links[own, len(kept) + 1 :] = (own + 1) % n
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 16)).astype(np.int32))

    def search(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of near centroids, nearest first; -1 and inf fill short rows."""
        parts = [self._search(x[i : i + 1024], beam) for i in range(0, len(x), 1024)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        q, n = len(x), len(self.c)
        rows, xx = np.arange(q), (x**2).sum(1)
        seen = np.zeros((q, n), dtype=bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (q, 1))
        d = xx[:, None] + self.norm[self.entries] - 2 * x @ self.c[self.entries].T
        width = max(beam, ids.shape[1])
        ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])), constant_values=-1)
        d = np.pad(d, ((0, 0), (0, width - d.shape[1])), constant_values=np.inf)
        done = ids < 0
        while True:
            open_ = np.where(done, np.inf, d)
            best = open_.argmin(1)
            active = np.flatnonzero(np.isfinite(open_[rows, best]))
            if not len(active):
                break
            done[active, best[active]] = True
            near = self.links[ids[active, best[active]]]
            fresh = ~seen[active[:, None], near]
            seen[active[:, None], near] = True
            dist = xx[active, None] + self.norm[near] - 2 * np.einsum("qd,qkd->qk", x[active], self.c[near])
            # a link that occurs twice in a row is fresh once
            order = np.sort(near, axis=1)
            if (order[:, 1:] == order[:, :-1]).any():
                for r in range(len(near)):
                    _, first = np.unique(near[r], return_index=True)
                    only = np.zeros(near.shape[1], bool)
                    only[first] = True
                    fresh[r] &= only
            dist = np.where(fresh, dist, np.inf)
            all_d = np.concatenate([d[active], dist], axis=1)
            all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            all_done = np.concatenate([done[active], ~fresh], axis=1)
            keep = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            d[active] = np.take_along_axis(all_d, keep, 1)
            ids[active] = np.take_along_axis(all_ids, keep, 1)
            done[active] = np.take_along_axis(all_done, keep, 1)
        order = np.argsort(d, axis=1, kind="stable")
        d = np.sqrt(np.maximum(np.take_along_axis(d, order, 1), 0))
        return np.take_along_axis(ids, order, 1), d

    def assign(self, x: np.ndarray) -> list[list[int]]:
        """Posting lists of each vector."""
        ids, d = self.search(x, BEAM)
        out = []
        for row, dist in zip(ids, d, strict=True):
            chosen = [int(row[0])]
            for c, e in zip(row[1:].tolist(), dist[1:].tolist(), strict=True):
                if c < 0 or e > BOUNDARY * dist[0] or len(chosen) == REPLICAS:
                    break
                if all(((self.c[c] - self.c[o]) ** 2).sum() >= APART * e * e for o in chosen):
                    chosen.append(c)
            out.append(chosen)
        return out

    def lists_of(self, x: np.ndarray) -> list[list[int]]:
        """Posting lists that each query reads."""
        ids, d = self.search(x, MOST_LISTS)
        out = []
        for row, dist in zip(ids, d, strict=True):
            n = int(np.searchsorted(dist, PRUNE * dist[0], side="right"))
            n = min(max(n, LEAST_LISTS), MOST_LISTS)
            out.append([int(c) for c in row[:n] if c >= 0])
        return out


def fit(entries: DataFrame, n: int, seed: int = 0) -> CentroidGraph:
    """The graph of centroids, from a sample of the n distinct vectors."""
    sample = entries.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("rep", "v").toArrow().sort_by("rep")
    lengths = np.array([len(v) for v in sample["v"].to_pylist()])
    dimension = int(np.bincount(lengths).argmax())
    x = matrix(sample["v"].filter(pa.array(lengths == dimension)))
    n_lists = int(np.clip(n // LIST_SIZE, 1, min(MAX_LISTS, len(x))))
    return CentroidGraph(balanced_centroids(x, n_lists, np.random.default_rng(seed)))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with ``is_query`` (over vec_id) the k nearest other rows."""
    rows = clean(vectors)
    order = W.partitionBy("v").orderBy("vec_id")
    entries = (
        rows.distinct()
        .withColumn("n", F.row_number().over(order))
        .where(f"n <= {k + 1}")
        .groupBy("v")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        .select(F.col("ids")[0].alias("rep"), "ids", "v")
    )
    entries = written(entries, "vectors")
    queries = rows.where(is_query).distinct()
    distinct_queries = written(queries.groupBy("v").agg(F.min("vec_id").alias("qid")), "queries")
    n = entries.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    graph = fit(entries, n)
    dimension = graph.c.shape[1]

    def post(assign, keys):
        def run(batches):
            for batch in batches:
                get = lambda c: batch.column(batch.schema.get_field_index(c))
                lists = assign(matrix(get("v"))) if batch.num_rows else []
                at = np.repeat(np.arange(batch.num_rows), [len(x) for x in lists])
                columns = [pa.array(np.array([c for x in lists for c in x], dtype=np.int32))]
                columns += [get(c).take(pa.array(at)) for c in keys]
                yield pa.RecordBatch.from_arrays(columns, ["list", *keys])

        return run

    same = F.size("v") == dimension
    kind = entries.schema["v"].dataType.simpleString()
    postings = spread(entries.where(same)).mapInArrow(
        post(graph.assign, ["rep", "ids", "v"]), f"list int, rep long, ids array<long>, v {kind}"
    )
    postings = written(postings, "postings")
    sizes = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(written(sizes, "sizes"))  # at most MAX_LISTS rows
    wanted = spread(distinct_queries.where(same)).mapInArrow(
        post(graph.lists_of, ["qid", "v"]), f"list int, qid long, v {kind}"
    )
    wanted = wanted.join(sizes, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "qid", "v"
    )
    postings = postings.join(sizes, "list").select(
        "list", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), "rep", "ids", "v"
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"qid": [], "rep": [], "score": [], "ids": []}
        if left.num_rows and right.num_rows:
            q, x = matrix(left["v"]), matrix(right["v"])
            qids, reps = left["qid"].to_numpy(), right["rep"].to_numpy()
            norm, picked = (x**2).sum(1), []
            for i, vector in enumerate(q):
                # The expanded form only proposes; what is kept is computed from the differences.
                d = norm - 2 * x @ vector
                if len(d) > k + 1:
                    limit = np.partition(d, k)[k]
                    some = np.flatnonzero(d <= limit + 1e-6 * (abs(limit) + 1 + vector @ vector))
                else:
                    some = np.arange(len(d))
                exact = np.sqrt(((x[some] - vector) ** 2).sum(1))
                best = np.lexsort((reps[some], exact))[: k + 1]
                out["qid"] += [qids[i]] * len(best)
                out["rep"] += reps[some[best]].tolist()
                out["score"] += exact[best].tolist()
                picked += some[best].tolist()
            out["ids"] = right["ids"].combine_chunks().take(pa.array(picked, pa.int64()))
        return pa.table(
            {
                "qid": pa.array(out["qid"], pa.int64()), "rep": pa.array(out["rep"], pa.int64()),
                "score": pa.array(out["score"], pa.float64()),
                "ids": out["ids"] if left.num_rows and right.num_rows else pa.array([], pa.list_(pa.int64())),
            }
        )

    found = (
        wanted.groupBy("list", "block")
        .cogroup(postings.groupBy("list", "block"))
        .applyInArrow(compare, "qid long, rep long, score double, ids array<long>")
    )
    top = W.partitionBy("qid").orderBy("score", "vec_id")
    found = (
        found.dropDuplicates(["qid", "rep"])
        .select("qid", "score", F.explode("ids").alias("vec_id"))
        .withColumn("n", F.row_number().over(top))
        .where(f"n <= {k + 1}")
    )
    asked = queries.join(distinct_queries, "v").select(F.col("vec_id").alias("query_id"), "qid")
    own = W.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        asked.join(found, "qid")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(own))
        .where(f"rank <= {k}")
        .select("query_id", "rank", "vec_id", "score")
    )
