"""Approximate nearest neighbours by inner product: an inverted multi-index.

Vectors are cut in halves; each half is lengthened by one component so that all halves have one norm, after which the
nearest half by distance is the one with the largest inner product. Each kind of half has its own codebook (k-means on
a bounded sample), and a vector's cell is its pair of centroids. A query walks centroid pairs by summed distance with
a heap until the cells hold the candidates it may look at; the sum at which it stops tells which cells it has visited.
Visited cells' vectors are reranked by the exact inner product.

How many candidates a query may look at is calibrated: a bounded sample of queries is answered by brute force, and the
number is chosen at which the walk has met the wanted share of their true neighbours.

Rows take part whose vector is there, not zero, without nulls and finite. Repeated ids count once. Halves of shorter
vectors end in zeros. Every row is indexed; codebooks and the table of cell sizes are bounded by MOST_CENTROIDS.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.vectors import alike, best, matrix
from cratewise.session import fixed

#: Vectors that the codebooks are fitted on, and queries that the walk is calibrated on, on average at most.
SAMPLE_VECTORS, SAMPLE_QUERIES = 16_000, 96
#: Vectors in a cell on average; centroids of a half at most.
CELL_VECTORS, MOST_CENTROIDS = 16, 1_024
#: Vectors that one task reranks at a time, about.
PART_VECTORS, QUERY_PART = 8_192, 1_024
ROUNDS = 10
#: Share of true neighbours that the calibrated walk meets on the sample.
WANTED = 0.95


class Index:
    """Codebooks and cell sizes."""

    def __init__(self, width: int, norms: tuple[float, float], books: list[np.ndarray]) -> None:
        self.width, self.norms, self.books = width, norms, books
        self.sizes = np.zeros((len(books[0]), len(books[1])), np.int64)

    def halves(self, rows: np.ndarray, query: bool = False) -> list[np.ndarray]:
        rows = np.pad(rows, ((0, 0), (0, max(0, self.width - rows.shape[1]))))
        cut = self.width // 2
        return [np.column_stack([h, np.zeros(len(h)) if query else np.sqrt(np.maximum(m * m - (h * h).sum(axis=1), 0))]) for h, m in zip((rows[:, :cut], rows[:, cut : self.width]), self.norms)]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(distances(h, book).argmin(axis=1) for h, book in zip(self.halves(rows), self.books))

    def walk(self, first: np.ndarray, second: np.ndarray, wanted: int) -> Iterator[tuple[float, int, int]]:
        """Pairs of centroids by summed distance, until their cells hold ``wanted`` vectors. first, second: the query's
        distances to the centroids of each half."""
        by = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        a, b = first[by[0]].tolist(), second[by[1]].tolist()
        sizes = self.sizes[by[0][:, None], by[1]]
        heap, met = [(a[0] + b[0], 0, 0)], 0
        while heap and met < wanted:
            total, i, j = heapq.heappop(heap)
            met += int(sizes[i, j])
            yield total, int(by[0][i]), int(by[1][j])
            if i + 1 < len(a) and j == 0:
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((rows**2).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres**2).sum(axis=1), 0)


def centroids(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = rows[rng.choice(len(rows), k, replace=False)].copy()
    for _ in range(ROUNDS):
        of = distances(rows, centres).argmin(axis=1)
        counts = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, weights=rows[:, d], minlength=k) for d in range(rows.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def exact_top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, visits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, ids, scores) of each query's k best rows, of those it visits; ties to the smaller id. A score depends
    on the two vectors alone, not on the rows beside them."""
    rows, queries = alike(rows, queries)
    near = queries @ rows.T
    near[query_ids[:, None] == ids] = -np.inf
    if visits is not None:
        near[~visits] = -np.inf
    if near.shape[1] > k:
        bar = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        bar = bar - 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
    else:
        bar = np.full(len(near), -np.inf)
    q, r = np.nonzero((near >= bar[:, None]) & (near > -np.inf))
    score = (queries[q] * rows[r]).sum(axis=1)
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    keep = place < k
    return query_ids[q[keep]], ids[r[keep]], score[keep]


def build(vectors: DataFrame, k: int) -> tuple[Index | None, DataFrame, int]:
    """The index, the written table (vec_id, embedding, c1, c2) of every vector, and the candidates a query may look at
    so that it meets WANTED of its k nearest."""
    rows = fixed(vectors.where(F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not n:
        return None, rows.select("*", F.lit(0).alias("c1"), F.lit(0).alias("c2")), 0
    cut = width // 2
    squares = [F.aggregate(F.slice("embedding", a, b), F.lit(0.0), lambda s, x: s + x * x) for a, b in ((1, cut), (cut + 1, width - cut))]
    norms = tuple(math.sqrt(x or 0) for x in rows.agg(*(F.max(s) for s in squares)).first())
    share = lambda most: F.pmod(F.xxhash64("vec_id", F.lit(most)), F.lit(1_000_000)) < F.lit(min(1_000_000, math.ceil(most * 1_000_000 / n)))
    sample = rows.where(share(SAMPLE_VECTORS)).orderBy("vec_id").toArrow()  # SAMPLE_VECTORS rows, give or take their square root
    if not sample.num_rows:
        sample = rows.limit(1).toArrow()
    index = Index(width, norms, [np.zeros((1, cut + 1)), np.zeros((1, width - cut + 1))])
    rng = np.random.default_rng(0)
    k_half = min(max(math.ceil(math.sqrt(n / CELL_VECTORS)), 1), MOST_CENTROIDS, sample.num_rows)
    index.books = [centroids(h, k_half, rng) for h in index.halves(matrix(sample.column("embedding"), width))]
    sent = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c1, c2 = sent.value.cells(matrix(batch.column("embedding")))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], ["vec_id", "embedding", "c1", "c2"])

    entries = fixed(rows.mapInArrow(assign, "vec_id long, embedding array<double>, c1 int, c2 int"))
    index.sizes = np.zeros((k_half, k_half), np.int64)
    counts = entries.groupBy("c1", "c2").count().toArrow()  # MOST_CENTROIDS squared rows at most
    index.sizes[counts.column("c1").to_numpy(), counts.column("c2").to_numpy()] = counts.column("count").to_numpy()
    return index, entries, calibrate(index, entries, rows.where(share(SAMPLE_QUERIES)).toArrow(), k)


def calibrate(index: Index, entries: DataFrame, asked: pa.Table, k: int) -> int:
    """Candidates that a walk must hold to meet WANTED of the true neighbours of the ``asked`` queries."""
    least = 10 * k
    if not asked.num_rows:
        return least
    query_ids, queries = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"), index.width)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy()
                q, v, s = exact_top(ids, matrix(batch.column("embedding"), queries.shape[1]), query_ids, queries, k)
                at = np.argsort(ids, kind="stable")
                at = at[np.searchsorted(ids, v, sorter=at)]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s), batch.column("c1").take(pa.array(at)), batch.column("c2").take(pa.array(at))], ["query_id", "vec_id", "score", "c1", "c2"])

    found = entries.mapInArrow(task, "query_id long, vec_id long, score double, c1 int, c2 int")
    true = best(found, k).join(found.select("query_id", "vec_id", "c1", "c2"), ["query_id", "vec_id"]).collect()  # k rows a sampled query
    first, second = (distances(h, b) for h, b in zip(index.halves(queries, query=True), index.books))
    place = {int(q): p for p, q in enumerate(query_ids)}
    needed = []
    order = {}
    for r in true:
        p = place[r.query_id]
        if p not in order:
            total = first[p][:, None] + second[p]
            flat = np.argsort(total, axis=None, kind="stable")
            met = np.empty(total.size, np.int64)
            met[flat] = np.cumsum(index.sizes.ravel()[flat])
            order[p] = met.reshape(total.shape)
        needed.append(int(order[p][r.c1, r.c2]))
    return max(least, int(np.quantile(needed, WANTED))) if needed else least


def search(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest found in ``vectors`` (both vec_id,
    embedding: array<double>), by largest inner product."""
    index, entries, wanted = build(vectors, k)
    if index is None:
        return entries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    queries = queries.where(F.exists("embedding", lambda x: x != 0)).select("vec_id", "embedding")
    sent = queries.sparkSession.sparkContext.broadcast((index, wanted))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, wanted = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            first, second = (distances(h, b) for h, b in zip(index.halves(matrix(batch.column("embedding")), query=True), index.books))
            who, c1, reach = [], [], []
            for q in range(batch.num_rows):
                visited: dict[int, float] = {}  # centroid of the first half -> largest distance visited in the second
                for _, i, j in index.walk(first[q], second[q], wanted):
                    visited[i] = max(visited.get(i, -1.0), float(second[q][j]))
                who += [q] * len(visited)
                c1 += visited
                reach += visited.values()
            rows = batch.take(pa.array(who, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("embedding"), pa.array(c1, pa.int32()), pa.array(reach, pa.float64())], ["vec_id", "embedding", "c1", "reach"])

    probes = queries.mapInArrow(walk, "vec_id long, embedding array<double>, c1 int, reach double")
    held = index.sizes.sum(axis=1)
    parts = F.array(*(F.lit(max(1, math.ceil(int(x) / PART_VECTORS))) for x in held))  # a crowded centroid is split
    n_parts = F.element_at(parts, F.col("c1") + 1)
    rounds = max(1, math.ceil(queries.count() / QUERY_PART))
    left = entries.select("*", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("q"))
    right = probes.select("*", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(rounds)).cast("int").alias("q"))

    def rerank(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if mine.num_rows and asked.num_rows:
            index, _ = sent.value
            rows, queries = matrix(mine.column("embedding"), index.width), matrix(asked.column("embedding"), index.width)
            to_second = distances(index.halves(queries, query=True)[1], index.books[1])
            visits = to_second[:, mine.column("c2").to_numpy()] <= asked.column("reach").to_numpy()[:, None] * (1 + 1e-12)
            found = exact_top(mine.column("vec_id").to_numpy(), rows, asked.column("vec_id").to_numpy(), queries, k, visits)
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    pairs = left.groupBy("c1", "part", "q").cogroup(right.groupBy("c1", "part", "q"))
    return best(pairs.applyInArrow(rerank, "query_id long, vec_id long, score double"), k)
