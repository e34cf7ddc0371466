"""Generation on a small catalog whose answers can be counted by hand."""

import re

import pytest
from pyspark.sql import functions as F

from cratewise.functions.features import SCALARS
from cratewise.plans import playlist as pl
from cratewise.plans.taste import Dims

DIMS = Dims(scalar=tuple(SCALARS), decades=("dec80", "dec90"), genres=("rock", "jazz"), languages=("lang_en", "lang_fr"))


@pytest.fixture(scope="module")
def world(spark):
    """30 artists with two rock songs of the eighties each, and 10 jazz songs of another ten artists."""
    zero = {s: 0.0 for s in SCALARS}
    rows = [dict(track_id=i, artist=f"a{i // 2}", title_key=f"t{i}", genre="rock", decade="dec80", language="lang_en", market="intl", tier=i % 3, hit=1 - i / 100, artist_rank=1 + i % 2, holiday=0,
                 confidence=1.0, clusters={"rock": 1.0}, **zero) for i in range(60)]
    rows += [dict(track_id=100 + i, artist=f"j{i}", title_key=f"j{i}", genre="jazz", decade="dec90", language="lang_fr", market="intl", tier=0, hit=0.5, artist_rank=1, holiday=0, confidence=1.0,
                  clusters={"jazz": 1.0}, **zero) for i in range(10)]
    kinds = "track_id long, artist string, title_key string, genre string, decade string, language string, market string, tier int, hit double, artist_rank int, holiday int, confidence double, clusters map<string,double>, "
    tracks = spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.rstrip(", ").split(", ")) + tuple(r[s] for s in SCALARS) for r in rows], kinds + ", ".join(f"{s} double" for s in SCALARS))
    scalars = spark.createDataFrame([(q, s, k, 50 if s == "mainstream" else 0, 50) for q in (1, 2, 3, 4) for k, s in enumerate(SCALARS)], "request long, k string, ord int, target int, weight int")
    groups = spark.createDataFrame([(q, "genres", "rock", 0, 1000) for q in (1, 2, 3, 4)] + [(q, "genres", "jazz", 1, 0) for q in (1, 2, 3, 4)], "request long, grp string, k string, ord int, p int")
    return tracks, scalars, groups


def make(spark, world, lengths, **options):
    tracks, scalars, groups = world
    requests = spark.createDataFrame([(q, n, f"s{q}") for q, n in lengths.items()], "request long, length int, seed string")
    picks, warnings = pl.generate(requests, scalars, groups, tracks, DIMS, **options)
    got = {q: {r.track_id for r in picks.where(F.col("request") == q).collect()} for q in lengths}
    said = {q: {r.warning for r in warnings.where(F.col("request") == q).collect()} for q in lengths}
    return got, said


def test_levels_warnings_and_exhaustion(spark, world):
    # Tier 0 holds rock songs 0, 3, 6, …: one for each of 20 artists, the cap of a short list.
    got, said = make(spark, world, {1: 20, 2: 25, 3: 80, 4: 1001})
    assert len(got[1]) == 20 and said[1] == set() and all(t % 3 == 0 and t < 60 for t in got[1])
    assert len(got[2]) == 25 and said[2] == {"hits_relaxed"} and all(t < 60 for t in got[2])
    assert len(got[3]) == 70 and {"hits_relaxed", "prefilter_relaxed", "catalog_exhausted"} <= said[3]  # everything there is
    assert got[4] == set() and said[4] == {"invalid_length"}


def test_a_request_that_has_every_title_is_offered_nothing_more(spark, world, monkeypatch):
    tracks, scalars, groups = world
    asked, offers = [], pl.offers

    def noted(cells, wanted, *rest):
        asked.extend(r.want for r in wanted.collect())
        return offers(cells, wanted, *rest)

    monkeypatch.setattr(pl, "offers", noted)
    rock = tracks.where("genre = 'rock'")
    got, said = make(spark, (rock, scalars, groups), {3: 80})
    assert len(got[3]) == 60 and said[3] == {"hits_relaxed", "prefilter_relaxed", "language_relaxed", "catalog_exhausted"}
    assert asked and min(asked) > 20  # the 20 that are missing are asked of no cell
    # Where an artist is not known the catalog cannot be counted out; the answer is the same.
    assert pl._words(tracks) == (40, 70) and pl._words(tracks.withColumn("artist", F.nullif("artist", F.lit("a3")))) == (None, 70)


def test_counts_of_cells_meet_limits_without_a_shuffle_of_their_product(spark, world, monkeypatch):
    """Nothing is small enough here to be broadcast unasked, as on a large catalog."""
    plans, write = [], pl.fixed

    def noted(df):
        if {"limit", "cut", "depth"} <= set(df.columns):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(pl, "fixed", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _ = make(spark, world, {1: 20})
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(got[1]) == 20 and plans
    for plan in plans:
        counted = re.search(r"BroadcastHashJoin \[cell#\d+, market#\d+, max_tier#\d+\]", plan)
        ruled = re.search(r"Join \[request#\w+, max_tier#\d+\]", plan)
        assert counted and ruled and counted.start() < ruled.start()  # the plan shows the last step first


def test_swap_after_a_page_keeps_to_new_artists(spark, world):
    previous = spark.createDataFrame([(1, t) for t in range(0, 24, 2)], "request long, track_id long")
    swap, _ = make(spark, world, {1: 3}, previous=previous, new_artists_only=True)
    assert len(swap[1]) == 3 and all(t >= 24 for t in swap[1])


def test_same_cell(spark, world):
    jazz = spark.createDataFrame([(1, 105)], "request long, track_id long")
    same, said = make(spark, world, {1: 4}, same_cell_as=jazz)
    assert len(same[1]) == 4 and all(t >= 100 for t in same[1]) and "prefilter_relaxed" in said[1]


def test_noise_is_fresh_for_every_pick():
    import numpy as np

    base = np.arange(2_000, dtype=np.uint64) * np.uint64(977)
    a, b = pl._gumbel(base, 0), pl._gumbel(base, 1)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.1 and abs(a.mean() - 0.5772) < 0.15 and (pl._gumbel(base, 0) == a).all()


def test_score_counts_every_cluster(spark, world):
    tracks, scalars, groups = world
    many = {f"g{k}": 0.1 for k in range(5)} | {"rock": 0.5}
    rows = tracks.limit(1).withColumn("clusters", F.create_map(*[F.lit(x) for pair in many.items() for x in pair])).join(pl.request_tastes(scalars, groups).where("request = 1"), F.lit(True))
    few = rows.withColumn("clusters", F.create_map(F.lit("rock"), F.lit(0.5)))
    assert rows.select(pl.score().alias("s")).first() == few.select(pl.score().alias("s")).first()


def test_score_spelled_out_equals_the_general_form(spark, world):
    tracks, scalars, groups = world
    clusters = F.create_map(F.lit("rock"), F.lit(0.5), F.lit("jazz"), F.lit(0.3), F.lit("folk"), F.lit(0.2))
    rows = tracks.withColumn("clusters", F.when(F.col("track_id") % 2 == 0, clusters).otherwise(F.col("clusters"))).join(pl.request_tastes(scalars, groups), F.lit(True))
    assert pl.most_clusters(rows) == 3
    assert rows.where(pl.score() != pl.score(slots=3)).count() == 0
    plan = rows.select(pl.score(slots=3))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan
