import math

import duckdb
import numpy as np
import pytest

from cratewise.llm import multiindex, topk
from cratewise.llm.queries import OP1_SQL, op1_threshold_topk, op4_multi_index
from tests.compare import difference

ODD = [(1, None), (2, []), (3, [float("nan")] * 8), (4, [1.0, None] * 4), (5, [float("inf")] * 8), (6, [0.0] * 8), (None, [1.0] * 8)]
SCHEMA = "vec_id long, embedding array<float>, label int, score int"


def vectors_of(spark, extra=()):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(20, 400)]
    common = rows[7][1]
    rows += [(i, common) for i in range(400, 520)]  # one vector many times: ties
    return spark.createDataFrame([(*r, 0, 1) for r in [*rows, *ODD, *extra]], SCHEMA), dict(rows)


def test_topk_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert difference(op1_threshold_topk(spark, folder), con.execute(OP1_SQL)) is None


@pytest.mark.parametrize("blocks", [(16_384, 1_024), (50, 2)])
def test_topk_equals_brute_force(spark, folder_of, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", blocks[0])
    monkeypatch.setattr(topk, "QUERY_BLOCK", blocks[1])
    monkeypatch.setattr(topk, "FIRST_DEPTH", 2)
    df, rows = vectors_of(spark, [(400, [9.0] * 8), (600, [1.0, 2.0])])
    rows |= {2: [], 6: [0.0] * 8, 600: [1.0, 2.0]}
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows.items()}
    got = [tuple(r) for r in op1_threshold_topk(spark, folder_of(embeddings=df)).collect()]
    want = []
    for q in (i for i in whole if i % 100 == 0):
        ranked = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
    assert sorted(got) == sorted(want)


def test_threshold_stops_early():
    """The bound ends the reading: only the heads of the lists are scored."""
    rows = np.zeros((5_000, 2), np.int64)
    rows[:, 0] = np.arange(5_000)

    class Watched(np.ndarray):
        pass

    ids = np.arange(5_000)
    found = topk.threshold_top(ids, rows, np.array([-1]), np.array([[3, 0]]), 10)
    assert found[1] == list(range(4_999, 4_989, -1)) and found[2][0] == 3 * 4_999


def test_zero_query_and_large_components():
    ids, rows = np.array([5, 3, 9]), np.array([[2**40], [2**41], [2**40]])
    assert topk.threshold_top(ids, rows, np.array([0]), np.array([[2**20]]), 2)[1:] == ([3, 5], [2**61, 2**60])
    assert topk.threshold_top(ids, rows, np.array([3]), np.array([[0]]), 2)[1:] == ([5, 9], [0, 0])


def brute(rows, query, k):
    return sorted((-sum(float(a) * float(b) for a, b in zip(rows[query], v)), i) for i, v in rows.items() if i != query)[:k]


def test_multi_index_recall(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = {}
    for r in op4_multi_index(spark, folder).collect():
        got.setdefault(r.query_id, []).append(r)
    hits = 0
    assert set(got) == {i for i in rows if i % 20 == 0}
    for q, found in got.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        true = brute(rows, q, 20)
        hits += len({i for _, i in true} & {r.vec_id for r in found})
        for r in found:
            assert r.score == pytest.approx(float(np.dot(np.array(rows[q], float), np.array(rows[r.vec_id], float))), abs=1e-12)
    assert hits / (20 * len(got)) >= 0.9


def test_multi_index_ties_and_odd_rows(spark, folder_of, monkeypatch):
    monkeypatch.setattr(multiindex, "PART_VECTORS", 30)
    monkeypatch.setattr(multiindex, "QUERY_PART", 5)
    df, rows = vectors_of(spark, [(410, [9.0] * 8)])
    got = {}
    for r in op4_multi_index(spark, folder_of(embeddings=df)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i in rows if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert len(found) == 20
        true = brute(rows, q, 20)
        hits += len({i for _, i in true} & {i for _, i, _ in found})
        for score in {s for _, _, s in found}:  # of equal scores the smaller ids
            ids = [i for _, i, s in found if s == score]
            assert ids == sorted(ids)
    assert hits / (20 * len(got)) >= 0.9
    copies = [i for i in rows if rows[i] == rows[420] and i != 420]
    shown = [i for _, i, _ in sorted(got[420]) if i in copies]
    assert shown and shown == sorted(copies)[: len(shown)]


def test_few_or_no_vectors(spark, folder_of):
    few = spark.createDataFrame([(i, [float(i), 1.0], 0, 0) for i in range(0, 60, 20)], SCHEMA)
    folder = folder_of(embeddings=few)
    assert op4_multi_index(spark, folder).count() == op1_threshold_topk(spark, folder).where("query_id = 0").count() * 3 == 6
    folder = folder_of(embeddings=few.limit(0))
    assert op4_multi_index(spark, folder).count() == op1_threshold_topk(spark, folder).count() == 0


def test_walk_is_in_order_of_summed_distance():
    index = multiindex.Index(2, (1.0, 1.0), [np.zeros((5, 2)), np.zeros((7, 2))])
    rng = np.random.default_rng(0)
    first, second = rng.random(5), rng.random(7)
    index.sizes[:] = 1
    walked = [(t, i, j) for t, i, j in index.walk(first, second, 35)]
    assert len({(i, j) for _, i, j in walked}) == 35 and [t for t, _, _ in walked] == sorted(t for t, _, _ in walked)
    assert len(list(index.walk(first, second, 9))) == 9
