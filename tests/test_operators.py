"""Operators against brute force on small fixtures, including one key that holds most rows."""

import random

import pytest
from pyspark.sql import functions as F

from cratewise.operators import aggregates, apportion, joins, ranking
from cratewise.queries.roles import Roles


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{i % 7}", rng.randrange(40)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id int, g string, v int")


def test_distributed_rank_equals_a_plain_window(skewed):
    rows, df = skewed
    got = {r["id"]: (r["rk"], r["n"]) for r in ranking.row_numbers(df, ["g"], [F.col("v").desc(), F.col("id").asc()]).collect()}
    for g in {r[1] for r in rows}:
        members = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        assert [got[r[0]] for r in members] == [(i + 1, len(members)) for i in range(len(members))]


def test_percent_rank_and_median_with_ties(skewed):
    rows, df = skewed
    got = {r["id"]: r["p"] for r in ranking.percent_ranks(df, ["g"], "v", "p").collect()}
    hot = [r for r in rows if r[1] == "hot"]
    for r in hot[:200]:
        assert got[r[0]] == pytest.approx(sum(x[2] < r[2] for x in hot) / (len(hot) - 1))
    med = {r["g"]: r["median"] for r in ranking.exact_median(df, ["g"], "v").collect()}
    values = sorted(x[2] for x in hot)
    assert med["hot"] == (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def test_spread_pick_and_apportion(spark):
    df = spark.createDataFrame([(i, 10) for i in range(10)], "i int, n int")
    assert sorted(r["i"] for r in ranking.evenly_spread(df, "i", "n", F.lit(4)).collect()) == [0, 1, 4, 8]
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 1), ("d", 0)], "k string, m int")
    got = {r["k"]: r["slots"] for r in apportion.with_floor_of_one(sizes, [], "m", F.lit(100), [F.col("k").asc()]).collect()}
    assert sum(got.values()) == 100 and got["c"] == 1 and got["d"] == 0


def _edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_similar_pairs_finds_exactly_the_pairs_above_the_threshold(spark):
    rng = random.Random(11)
    left = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 30))).strip() or "a" for _ in range(120)})
    right = set(left[::5]) | {w + " 5" for w in left[:20]} | {w[::-1] for w in left[:20]}
    for w in left:
        v = list(w)
        for _ in range(rng.randrange(1, 5)):
            at = rng.randrange(len(v) + 1)
            v[at:at + rng.randrange(2)] = rng.choice(["", "a", "bz"])
        right.add("".join(v) or "a")
    right = sorted(right)
    mk = lambda ws: spark.createDataFrame([("b", w) for w in ws], "blk string, t string")
    got = {(r["lv"], r["rv"]) for r in joins.similar_pairs(mk(left), mk(right), ["blk"], "t").collect()}
    digits = lambda s: "".join(x for x in s if x.isdigit())
    want = {(a, b) for a in left for b in right if digits(a) == digits(b) and (a == b or 1 - _edit(a, b) / max(len(a), len(b)) >= 0.85)}
    assert got == want and len(want) > 20


def test_chunks_are_more_than_the_edits_at_every_length():
    for threshold in (0.6, 0.75, 0.85, 0.9):
        sizes = joins.gram_sizes(threshold)
        for n in range(1, 3_000):
            edits = int((1 - threshold) * n / threshold + 1e-9)
            size = sizes[min(joins.length_class(n, threshold), len(sizes) - 1)]
            assert not edits or 0 < size * (edits + 1) <= n, (threshold, n)


def test_very_long_titles_are_matched_with_rows_in_proportion(spark):
    rng = random.Random(12)
    base = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    near = list(base)
    for at in rng.sample(range(5_000), 600):
        near[at] = "z"
    far = "".join(rng.choice("abcdefgh ") for _ in range(5_000))
    mk = lambda ws: spark.createDataFrame([("b", w) for w in ws], "blk string, t string")
    out = joins.similar_pairs(mk([base, "short title"]), mk(["".join(near), far, "short titel", "shirt title"]), ["blk"], "t")
    assert {(r["lv"][:5], r["rv"][:5]) for r in out.collect()} == {(base[:5], "".join(near)[:5]), ("short", "shirt")}


@pytest.mark.parametrize("heavy_key", [1, 3, 20, 1_000])
def test_sibling_totals_equal_listing_the_pairs(spark, heavy_key):
    rng = random.Random(3)
    keys = {(rec, "hot" if rng.random() < 0.4 else f"k{rng.randrange(60)}") for rec in range(200) for _ in range(rng.randrange(1, 4))}
    own = [(rec % 50, rec) for rec in range(200)]
    song_keys = {(s, k) for s, rec in own for r2, k in keys if rec == r2 and s % 2 == 0}
    df = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    out = joins.sibling_totals(
        df(song_keys, "song int, key string"), df(own, "song int, recording int"), df(keys, "recording int, key string"),
        df([(i, i * 3) for i in range(200)], "recording int, v int"), {"n": F.lit(1), "s": F.col("v")}, heavy_key=heavy_key,
    )
    got = {r["song"]: (r["n"], r["s"]) for r in out.where("n > 0").collect()}
    want = {}
    for s in range(0, 50, 2):
        mine = {k for x, k in song_keys if x == s}
        sib = {rec for rec, k in keys if k in mine} - {rec for x, rec in own if x == s}
        if sib:
            want[s] = (len(sib), sum(3 * x for x in sib))
    assert got == want


def test_siblings_keep_nothing_that_no_song_asks_for(spark, monkeypatch):
    kept, write = [], joins.fixed
    monkeypatch.setattr(joins, "fixed", lambda df: kept.append(write(df)) or kept[-1])
    keys = [(rec, "asked") for rec in range(5)] + [(rec, f"other{rec % 2}") for rec in range(5, 60)]
    out = joins.sibling_totals(
        spark.createDataFrame([(1, "asked")], "song int, key string"), spark.createDataFrame([(1, 0)], "song int, recording int"),
        spark.createDataFrame(keys, "recording int, key string"), spark.createDataFrame([(i, i) for i in range(60)], "recording int, v int"),
        {"n": F.lit(1), "s": F.col("v")}, heavy_key=3,
    )
    assert [tuple(r) for r in out.collect()] == [(1, 4, 10)]
    assert kept and all(df.where("recording >= 5").isEmpty() for df in kept if "recording" in df.columns)
    assert all(df.where("key <> 'asked'").isEmpty() for df in kept if "key" in df.columns)


def test_decimal_sums_round_as_decimals_and_add_whole_numbers(spark):
    odd = [0.000005, 0.000015, 0.123455, 0.1234549999999999, -0.000005, 0.333335, 1.0, 0.0, 999.999995, 1_234_567.123455, None]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(odd * 3)], "g int, p double")
    out = aggregates.decimal_sums(df, ["g"], ["p"])
    want = df.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("p").cast("decimal(12,5)")).alias("p"))
    assert out.schema["p"].dataType == want.schema["p"].dataType
    assert sorted(out.collect()) == sorted(want.collect())
    each = df.select(aggregates.hundred_thousandths(F.col("p")).alias("a"), (F.col("p").cast("decimal(12,5)") * 100_000).cast("long").alias("b"))
    assert each.where("not (a <=> b)").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(cast(p" not in plan


def test_the_size_of_a_file_does_not_make_a_broadcast(spark, tmp_path):
    session = Roles(spark.newSession(), str(tmp_path)).spark
    session.range(4_000_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000)).alias("k")).write.parquet(f"{tmp_path}/many")
    many = session.read.parquet(f"{tmp_path}/many")  # 4 million rows in some 5 MB
    plan = session.range(1_000_000_000).withColumnRenamed("id", "k").join(many, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    few = session.createDataFrame([(1,)], "k long")
    assert "Broadcast" in many.join(F.broadcast(few), "k")._jdf.queryExecution().executedPlan().toString()


def test_hierarchy_stops_at_labelled_nodes(spark):
    parents = spark.createDataFrame([(5, 4), (4, 3), (3, 1), (7, 6), (2, 1)], "child int, parent int")
    labels = spark.createDataFrame([(1, "US"), (4, "IL"), (2, "FR")], "node int, label string")
    nodes = spark.createDataFrame([(5,), (3,), (7,), (2,)], "node int")
    assert {tuple(r) for r in joins.nearest_label(nodes, parents, labels).collect()} == {(5, "IL"), (3, "US"), (2, "FR")}


def test_entity_match_rules(spark):
    left = spark.createDataFrame([
        (1, "hello", ["adele"], ["C1"], False), (2, "hello", ["adele"], [], False), (3, "symphony no 5", ["berliner"], [], False), (4, "hello", ["adele"], [], True),
    ], "left_id int, k string, artists array<string>, codes array<string>, live boolean")
    right = spark.createDataFrame([
        (10, "other", ["x"], ["C1"], False), (11, "hello", ["adelle"], [], True), (12, "helo", ["adele"], [], False), (13, "hello", ["lionel"], [], False),
        (14, "symphony no 9", ["berliner"], [], False), (15, "hello", ["adele"], [], False),
    ], "right_id int, k string, artists array<string>, codes array<string>, live boolean")
    got = {r["left_id"]: (r["right_id"], r["via"]) for r in joins.match_entities(left, right).collect()}
    assert got == {1: (10, "isrc"), 2: (15, "search"), 4: (15, "search")}


def test_repair_removes_neighbours():
    import numpy as np

    from cratewise.plans.playlist import _repair

    rng = np.random.default_rng(3)
    clashes = lambda seq, before: sum(a == b for a, b in zip([before, *seq], seq))
    for _ in range(300):
        n = int(rng.integers(1, 12))
        artist, before = rng.integers(0, 5, n), int(rng.integers(-1, 5))
        order = rng.permutation(n).tolist()
        fixed_ = _repair(order, artist, before)
        assert sorted(fixed_) == sorted(order)
        assert clashes(artist[fixed_].tolist(), before) <= clashes(artist[order].tolist(), before)
    assert clashes(np.array([0, 0, 1, 2, 2, 3])[_repair([0, 1, 2, 3, 4, 5], np.array([0, 0, 1, 2, 2, 3]))].tolist(), -1) == 0
