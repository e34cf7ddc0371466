"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidates and queries are dealt into blocks of bounded size, and each block of queries meets each block of
candidates. In a block every dimension has its list of candidates sorted by component. A query reads all lists from
its better end in step, scores each candidate it meets for the first time in full, and stops when the best score that
an unread candidate could have (the sum over the dimensions of the query's component times the list's at the depth
read) is below the k-th score found. Each block returns k rows a query at most.

Rows take part whose vector is there, has no null and is finite. A query's own id is no candidate. Repeated ids count
once. Vectors of different lengths meet over their common components. Scores are exact while they fit in a long.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.vectors import alike, best, block_of, matrix
from cratewise.session import fixed

CANDIDATE_BLOCK, QUERY_BLOCK = 16_384, 1_024
#: Depth to which the lists are read first; it doubles.
FIRST_DEPTH = 32


def threshold_top(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query ids, candidate ids, scores) of each query's k best of one block, and how many candidates were scored."""
    rows, queries = alike(rows, queries)
    if float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(rows.shape[1], 1) < 2**53:
        rows, queries = rows.astype(float), queries.astype(float)  # exact, and the faster product
    order = np.argsort(rows, axis=0, kind="stable").T
    values = np.take_along_axis(rows, order.T, axis=0).T
    out: tuple[list, list, list] = ([], [], [])
    n = len(ids)
    for query_id, q in zip(query_ids, queries):
        active = np.flatnonzero(q)
        down = q[active] > 0  # read from the largest component
        seen = ids == query_id
        top_ids, top = np.zeros(0, np.int64), np.zeros(0, rows.dtype)
        depth, until = 0, FIRST_DEPTH if len(active) else n
        while depth < n:
            until = min(until, n)
            if len(active):
                places = np.where(down[:, None], n - 1 - np.arange(depth, until), np.arange(depth, until))
                met = np.zeros(n, bool)
                met[order[active[:, None], places].ravel()] = True
                fresh = np.flatnonzero(met & ~seen)
            else:
                fresh = np.flatnonzero(~seen)
            seen[fresh] = True
            score = rows[fresh] @ q
            if len(top) == k:
                better = score >= top[-1]
                fresh, score = fresh[better], score[better]
            top, top_ids = np.append(top, score), np.append(top_ids, ids[fresh])
            first = np.lexsort((top_ids, -top))[:k]
            top, top_ids = top[first], top_ids[first]
            bound = (q[active] * values[active, np.where(down, n - until, until - 1)]).sum()
            if len(top) == k and bound < top[-1]:
                break
            depth, until = until, 2 * until
        out[0].extend([int(query_id)] * len(top))
        out[1].extend(top_ids.tolist())
        out[2].extend(int(s) for s in top)
    return out


def search(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k best of ``candidates`` (both vec_id, vector:
    array<bigint>)."""
    queries, candidates = fixed(queries.select("vec_id", "vector")), fixed(candidates.select("vec_id", "vector"))
    wide, deep = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(candidates.count() / CANDIDATE_BLOCK))
    left = candidates.select("*", block_of(deep).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("q"))
    right = queries.select("*", block_of(wide).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("c"))

    def task(mine: pa.Table, asked: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if mine.num_rows and asked.num_rows:
            found = threshold_top(mine.column("vec_id").to_numpy(), matrix(mine.column("vector")), asked.column("vec_id").to_numpy(), matrix(asked.column("vector")), k)
        return pa.table([pa.array(x, pa.int64()) for x in found], ["query_id", "vec_id", "score"])

    keys = [F.col("c").cast("long"), F.col("q").cast("long")]
    pairs = left.withColumns({"c": keys[0], "q": keys[1]}).groupBy("c", "q").cogroup(right.withColumns({"c": keys[0], "q": keys[1]}).groupBy("c", "q"))
    return best(pairs.applyInArrow(task, "query_id long, vec_id long, score long"), k)
