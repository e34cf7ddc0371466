"""Generation, order, shortlists and replacements against plain programs written from their rules."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cratewise.functions.features import SCALARS
from cratewise.plans import playlist as pl
from cratewise.plans.taste import Dims

DIMS = Dims(scalar=tuple(SCALARS), decades=("dec80", "dec90"), genres=("rock", "jazz"), languages=("lang_en", "lang_fr"))


@pytest.fixture(scope="module")
def hot(spark):
    """Two cells of equal weight. One artist has the 300 best rock songs of 1,000; half of the other rock songs share 30 titles."""
    kinds = "track_id long, artist string, title_key string, genre string, decade string, language string, market string, tier int, hit double, artist_rank int, holiday int, confidence double, clusters map<string,double>, "
    rows = []
    for i in range(1_000):
        title = f"same{i % 30}" if i >= 300 and i % 2 else f"t{i}"
        artist = "hot" if i < 300 else f"a{i // 3}"
        rows.append((i, artist, title, "rock", "dec80", "lang_en", "intl", 0, 1 - i / 2_000, 1 + i % 3, 0, 1.0, {"rock": 1.0 if i < 300 else 0.9 - i / 10_000}, *[0.0] * len(SCALARS)))
    for i in range(400):
        rows.append((2_000 + i, f"j{i}", f"j{i}", "jazz", "dec80", "lang_en", "intl", 0, 0.5, 1, 0, 1.0, {"jazz": 1.0}, *[0.0] * len(SCALARS)))
    tracks = spark.createDataFrame(rows, kinds + ", ".join(f"{s} double" for s in SCALARS))
    scalars = spark.createDataFrame([(q, s, k, -100 if s == "mainstream" else 0, 50) for q in (1, 2, 3) for k, s in enumerate(SCALARS)], "request long, k string, ord int, target int, weight int")
    groups = spark.createDataFrame([(q, "genres", g, k, 500) for q in (1, 2, 3) for k, g in enumerate(("rock", "jazz"))], "request long, grp string, k string, ord int, p int")
    return tracks, scalars, groups


def per_cell(spark, hot, lengths, **options):
    tracks, scalars, groups = hot
    requests = spark.createDataFrame([(q, n, f"s{q}") for q, n in lengths.items()], "request long, length int, seed string")
    picks, _ = pl.generate(requests, scalars, groups, tracks, DIMS, **options)
    rows = picks.join(tracks.select("track_id", "artist", "title_key"), "track_id").collect()
    for q in lengths:
        mine = [r for r in rows if r.request == q]
        artists = pd.Series([r.artist for r in mine]).value_counts()
        assert len({r.title_key for r in mine}) == len({r.track_id for r in mine}) == len(mine) == lengths[q]
        assert artists.max() <= (1 if lengths[q] <= 25 else 2)
        assert sorted(r.ord for r in mine) == list(range(len(mine)))
    return {(r.request, r.cell): sum(x.request == r.request and x.cell == r.cell for x in rows) for r in rows}


def test_a_cell_that_one_artist_leads_is_read_on(spark, hot, monkeypatch):
    lengths = {1: 20, 2: 80, 3: 200}
    got = per_cell(spark, hot, lengths)
    assert got == {(q, f"{g}|dec80"): n // 2 for q, n in lengths.items() for g in ("rock", "jazz")}
    monkeypatch.setattr(pl, "OFFER", 10_000)  # whole cells at once
    assert per_cell(spark, hot, lengths) == got


def test_a_cell_that_is_really_exhausted_gives_its_share_away(spark, hot):
    # Rock holds 30 shared titles and about 350 of its own; a page before takes all jazz but 20 songs.
    before = hot[0].where("track_id >= 2020").select(F.lit(1).cast("long").alias("request"), "track_id")
    assert per_cell(spark, hot, {1: 60}, previous=before) == {(1, "rock|dec80"): 40, (1, "jazz|dec80"): 20}


# --- order -------------------------------------------------------------------------------------------
def plain_order(energy, tempo, artist, weight, before=None):
    n = len(energy)
    curve = lambda x: 0.5 + 0.5 * x / 0.65 if x <= 0.65 else 1 - 0.15 * (x - 0.65) / 0.2 if x <= 0.85 else 0.85 - 0.55 * (x - 0.85) / 0.15
    heights = [round(curve(i / (n - 1) if n > 1 else 0), 9) for i in range(n)]
    target = dict(zip(sorted(range(n), key=lambda i: (heights[i], i)), sorted(energy)))
    left, out, played, speed = set(range(n)), [], before and before[0], before and before[1]
    for i in range(n):
        cost = {k: abs(energy[k] - target[i]) + (0 if speed is None else weight * abs(tempo[k] - speed)) for k in left}
        k = min(left, key=lambda k: (artist[k] == played, cost[k], k))
        left.remove(k)
        out.append(k)
        played, speed = artist[k], tempo[k]
    names = lambda o: [before and before[0], *(artist[k] for k in o)]

    def clashes(o, at):
        a = names(o)
        return a[at + 1] == a[at] or at + 2 < len(a) and a[at + 1] == a[at + 2]

    for i in range(n):
        if names(out)[i + 1] == names(out)[i]:
            for k in range(n):
                trade = list(out)
                trade[i], trade[k] = trade[k], trade[i]
                if k not in (i, i - 1) and not clashes(trade, i) and not clashes(trade, k):
                    out = trade
                    break
    return out


def test_order_follows_the_rule():
    rng = random.Random(2)
    for case in range(300):
        n = rng.randrange(1, 14)
        artist = [f"a{rng.randrange(rng.choice([2, 3, 9]))}" for _ in range(n)]
        energy, tempo = ([rng.randrange(-8, 9) / 8 for _ in range(n)] for _ in range(2))
        before = (artist[0], 0.25) if case % 3 == 0 else None
        rows = pd.DataFrame({"request": 1, "track_id": range(n), "score": 1, "ord": range(n), "artist": artist, "energy": energy, "tempo": tempo})
        if before:
            rows = pd.concat([rows, pd.DataFrame([{"request": 1, "track_id": -1, "score": 0, "ord": -1, "artist": before[0], "energy": 0.0, "tempo": before[1]}])])
        got = pl._order(rows, 0.5)
        assert got.sort_values("pos")["track_id"].tolist() == plain_order(energy, tempo, artist, 0.5, before), case


# --- shortlists --------------------------------------------------------------------------------------
def plain_choice(songs, liked, n):
    """``songs``: (pos, artist, title, cell, score)."""
    by_pos = {s[0]: s for s in songs}
    want, cap = min(n, len(songs)), 1 if n <= 25 else 2
    cells = list(dict.fromkeys(s[3] for s in sorted(songs)))
    exact = {c: sum(s[3] == c for s in songs) / len(songs) * want for c in cells}
    quota = {c: int(round(exact[c], 9) // 1) for c in cells}
    for c in sorted(cells, key=lambda c: (-round(round(exact[c], 9) - quota[c], 6), cells.index(c)))[: want - sum(quota.values())]:
        quota[c] += 1
    best = sorted(songs, key=lambda s: (-s[4], s[0]))
    kept = []
    for turn, offered in enumerate(([by_pos[x] for x in dict.fromkeys(liked) if x in by_pos], best, best)):
        for s in offered:
            mine = [by_pos[k] for k in kept]
            if len(kept) == want or s[0] in kept or s[2] in {m[2] for m in mine} or sum(m[1] == s[1] for m in mine) == cap:
                continue
            if turn == 2 or sum(m[3] == s[3] for m in mine) < quota[s[3]]:
                kept.append(s[0])
    return sorted(kept)


def test_choice_from_a_shortlist_follows_the_rule(spark):
    rng = random.Random(6)
    songs, liked, wanted, want = [], [], [], {}
    for q in range(40):
        size, n = rng.randrange(1, 90), rng.choice([1, 5, 20, 26, 40])
        mine = [(k, f"a{rng.randrange(max(1, size // 2))}", f"t{rng.randrange(2 * size)}", f"c{rng.randrange(5)}", rng.randrange(20)) for k in range(1, size + 1)]
        order = [rng.randrange(1, size + 4) for _ in range(rng.randrange(0, size))]
        songs += [(q, *s) for s in mine]
        liked += [(q, pos, k) for k, pos in enumerate(order)]
        wanted.append((q, n))
        want[q] = plain_choice(mine, order, n)
    shortlist = spark.createDataFrame(songs, "request long, pos long, artist string, title_key string, cell string, score int")
    out = pl.choose_from_shortlist(shortlist, spark.createDataFrame(liked, "request long, pos long, pref long"), spark.createDataFrame(wanted, "request long, n int"))
    got = {q: [] for q in want}
    for r in out.collect():
        got[r.request].append(r.pos)
    assert {q: sorted(x) for q, x in got.items()} == want


# --- replacements ------------------------------------------------------------------------------------
def test_replacements_follow_the_rule(spark):
    rng = random.Random(8)
    pool, shown, missing, want = [], [], [], {}
    for q in range(25):
        songs = [(q, f"c{rng.randrange(3)}", 1_000 * q + k, f"a{rng.randrange(12)}", rng.randrange(50)) for k in range(rng.randrange(0, 30))]
        listed = [(q, f"a{k}") for k in rng.sample(range(12), 3)]
        gaps = [(q, 7 * k + 1, f"c{rng.randrange(4)}") for k in range(rng.randrange(0, 6))]
        pool, shown, missing = pool + songs, shown + listed, missing + gaps
        best = {}  # of each new artist, the best song
        for s in sorted(songs, key=lambda s: (-s[4], s[2])):
            if (q, s[3]) not in listed:
                best.setdefault(s[3], s)
        offers, rest = sorted(best.values(), key=lambda s: (-s[4], s[2])), []
        for _, pos, cell in sorted(gaps):
            own = [s for s in offers if s[1] == cell]
            if own:
                offers.remove(own[0])
                want[q, pos] = own[0][2]
            else:
                rest.append(pos)
        want |= {(q, pos): s[2] for pos, s in zip(rest, offers)}
    out = pl.backfill(spark.createDataFrame(missing, "request long, pos long, cell string"), spark.createDataFrame(pool, "request long, cell string, track_id long, artist string, score int"),
                      spark.createDataFrame(shown, "request long, artist string"))
    assert {(r.request, r.pos): r.track_id for r in out.collect()} == want


def test_draws_without_replacement_follow_their_weights(spark):
    """Each of many requests draws 1 of 3 songs: shares are those of exp(score / T); and a draw is repeatable."""
    rows = [(q, "c", 1, k, score) for q in range(6_000) for k, score in ((1, 0), (2, int(0.1 * pl.SCORE_SCALE)), (3, int(0.2 * pl.SCORE_SCALE)))]
    pool = spark.createDataFrame(rows, "request long, cell string, slots int, track_id long, score int")
    seeds = spark.range(6_000).select(F.col("id").alias("request"), F.concat(F.lit("s"), "id").alias("seed"))
    drawn = pl.softmax_draw(pool, seeds)
    n = {r.track_id: r["count"] for r in drawn.groupBy("track_id").count().collect()}
    weight = np.exp([0.0, 1.0, 2.0])
    for k, w in zip((1, 2, 3), weight / weight.sum()):
        assert abs(n[k] / 6_000 - w) < 0.03
    assert drawn.exceptAll(pl.softmax_draw(pool.repartition(3), seeds)).count() == 0
