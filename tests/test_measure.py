"""Measures of playlists against plain programs."""

import random

import pytest

from cratewise.functions.features import SCALARS
from cratewise.plans import measure


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    sizes = {1: 1, 2: 2, 3: 30, None: 7, 5: 80, 6: 3}
    some = lambda: draw.randint(-20, 20) / 20 if draw.random() < 0.95 else None
    return [(q, *[None if q == 6 else some() for _ in SCALARS]) for q, n in sizes.items() for _ in range(n)]


def plain(rows):
    """A value that is not known lies below all others and adds nothing of its own."""
    out = {}
    for q in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == q]
        n, total = len(mine), 0.0
        for axis in zip(*mine):
            ordered = sorted(axis, key=lambda x: (x is not None, x or 0))
            total += sum(x * (2 * i - n + 1) for i, x in enumerate(ordered) if x is not None)
        known = any(x is not None for r in mine for x in r)
        out[q] = 0.0 if n < 2 else round(total / (n * (n - 1) / 2) / (2 * len(SCALARS)), 9) if known else None
    return out


def found(spark, rows):
    table = spark.createDataFrame(rows, "playlist_id long, " + ", ".join(f"{s} double" for s in SCALARS))
    got = measure.mean_pairwise_distance(table).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.playlist_id: r.diversity if r.diversity is None else round(r.diversity, 9) for r in got}


def test_distances_need_no_row_for_every_axis(spark, rows, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("rows were unpivoted")

    monkeypatch.setattr(measure, "prefix_totals", refused)
    assert found(spark, rows) == plain(rows)


def test_distances_of_large_playlists_are_dealt_out(spark, rows, monkeypatch):
    monkeypatch.setattr(measure, "RANKED_WHOLE", 6)
    assert found(spark, rows) == plain(rows)
