"""Catalog stages that SQL cannot express, against plain programs written from their rules."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cratewise.functions.features import AUDIO_DIMS
from cratewise.operators.ranking import average_rank_scale
from cratewise.plans import assemble, impute, sample

DIMS = ["energy", "valence"]


@pytest.fixture(scope="module")
def design(spark):
    """Rows as ``design_matrix`` gives them: 400 songs in five splits, two axes, some without a label or a decade."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        shared = [float(x) for x in rng.normal(size=3).round(3)]
        own = [float(x) for x in rng.normal(size=2).round(3)] + [float(rng.integers(0, 2)) for _ in range(2)]
        y = [float(np.clip(0.4 * shared[0] - 0.2 * shared[1] + 0.3 * own[0] + rng.normal() / 8, -1, 1).round(4)), None if rng.random() < 0.2 else float(rng.uniform(-1, 1))]
        split = int(rng.choice([0, 0, 0, 0, 1, 2, 3, 4]))
        rows.append((i, split, [None, "dec80", "dec90"][i % 3], *shared, own[0], own[1], own[2], own[3], *(y if split != 4 else (None, None))))
    names = "song int, split int, decade string, w_a double, w_b double, loglisten double, art_energy double, rg_energy double, has_art double, has_rg double, y_energy double, y_valence double"
    df = spark.createDataFrame(rows, names).withColumns({"art_valence": F.col("art_energy") / 2, "rg_valence": -F.col("rg_energy")})
    return df, ["w_a", "w_b", "loglisten"], df.toPandas()


def plain_ridge(pdf, shared, d):
    columns = [*shared, f"art_{d}", "has_art", f"rg_{d}", "has_rg"]
    x = lambda part: np.column_stack([np.ones(len(part)), part[columns].to_numpy(float)])
    of = lambda k: pdf[(pdf["split"] == k) & pdf[f"y_{d}"].notna()]
    train, val = of(0), of(1)
    best = None
    for lam in (0.1, 1.0, 10.0, 100.0):
        penalty = lam * np.eye(len(columns) + 1)
        penalty[0, 0] = 0
        beta = np.linalg.solve(x(train).T @ x(train) + penalty, x(train).T @ train[f"y_{d}"].to_numpy(float))
        error = np.abs(np.clip(x(val) @ beta, -1, 1) - val[f"y_{d}"].to_numpy(float)).sum()
        if best is None or error < best[0]:
            best = (error, lam, beta)
    return best[1], best[2], lambda part: np.clip(x(part) @ best[2], -1, 1), float(train[f"y_{d}"].mean())


def test_ridge_predictions_and_report_equal_numpy(design):
    df, shared, pdf = design
    model = impute.fit(df.repartition(5), shared, DIMS)
    plain = {d: plain_ridge(pdf, shared, d) for d in DIMS}
    for d in DIMS:
        lam, beta, _, mean = plain[d]
        got = [model[d]["intercept"], *(model[d]["weights"][n] for n in [*shared, f"art_{d}", "has_art", f"rg_{d}", "has_rg"])]
        assert model[d]["lambda"] == lam and np.allclose(got, beta, atol=1e-8) and math.isclose(model[d]["mean"], mean, abs_tol=1e-9)
    predicted = {r.song: (r.energy, r.valence, r.model_has_artist) for r in impute.predict(df, model).collect()}
    targets = pdf[pdf["split"] == 4]
    want = {int(s): (e, v, a) for s, e, v, a in zip(targets["song"], plain["energy"][2](targets), plain["valence"][2](targets), targets["has_art"])}
    assert predicted.keys() == want.keys() and all(np.allclose(predicted[s], want[s], atol=1e-8) for s in want)

    expected = {}
    for d in DIMS:
        for split in (2, 3):
            held = pdf[(pdf["split"] == split) & pdf[f"y_{d}"].notna()]
            parts = [(None, held)] + ([(k, held[held["decade"].fillna("unknown") == k]) for k in ("dec80", "dec90", "unknown")] if split == 2 else [])
            for k, part in parts:
                y = part[f"y_{d}"].to_numpy(float)
                expected[d, split, k] = (len(part), np.abs(plain[d][2](part) - y).mean(), np.abs(plain[d][3] - y).mean())
    got = {(r.dim, r.split, r.decade): (r.n, r.mae, r.baseline) for r in impute.holdout_report(df, model).collect()}
    assert got.keys() == expected.keys() and all(np.allclose(got[k], expected[k], atol=1e-8) for k in expected)


def test_tiers_merge_by_the_first_that_a_song_has(spark):
    rng = random.Random(3)
    draw = lambda: round(rng.uniform(-1, 1), 3)
    songs = list(range(30))
    tiers = [{s: {d: draw() for d in AUDIO_DIMS} | {"certainty": 0.5, "bpm": 100.0 + s} for s in songs if keep(s)} for keep in (lambda s: s % 3 == 0, lambda s: s % 3 == 1, lambda s: s % 3 == 2)]
    lean = {s: {"intensity": (None if s % 4 else draw(), draw()), "complexity": (None if s % 5 else draw(), draw())} for s in songs if s != 29}

    def frame(rows, extra):
        kinds = "song int, " + ", ".join(f"{d} double" for d in AUDIO_DIMS) + extra
        return spark.createDataFrame([tuple([s, *(x[d] for d in AUDIO_DIMS), *(x[e] for e in (("certainty", "bpm") if "certainty" in extra else ("has",)))]) for s, x in rows.items()], kinds)

    own, sibling = (frame(t, ", certainty double, bpm double") for t in tiers[:2])
    model = frame({s: x | {"has": float(s % 2)} for s, x in tiers[2].items()}, ", model_has_artist double")
    nudges = spark.createDataFrame([(s, d, *x) for s, of in lean.items() for d, x in of.items()], "song int, dim string, tag_mean double, prior double")
    got = {r.song: r for r in assemble.merge_tiers(spark.createDataFrame([(s,) for s in songs], "song int"), own, sibling, model, nudges).collect()}
    assert sorted(got) == songs
    for s in songs:
        at = s % 3
        x, r = tiers[at][s], got[s]
        (it, ip), (ct, cp) = (lean.get(s, {}).get(d, (None, 0.0)) for d in ("intensity", "complexity"))
        confidence = (0.875, 0.8 * 0.875, 0.6 if s % 2 else 0.45)[at]
        complexity = cp if ct is None else 0.5 * ct + 0.5 * cp
        want = (("ab_direct", "ab_sibling", "model")[at], x["energy"], x["tempo"], max(-1, min(1, x["intensity"] + 0.5 * (it or 0) + ip)), complexity, confidence)
        assert r.feature_source == want[0] and np.allclose((r.raw_energy, r.raw_tempo, r.raw_intensity, r.raw_complexity, r.confidence), want[1:], atol=1e-12)
        assert r.raw_bpm == (x["bpm"] if at < 2 else None)


def test_scaled_axes_are_average_ranks(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(12) / 4, float(i % 3)) for i in range(150)]
    got = {r.id: (r.a, r.b) for r in average_rank_scale(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"]).collect()}
    for i, *values in rows:
        for k, v in enumerate(values):
            column = [r[k + 1] for r in rows]
            rank = sum(x < v for x in column) + (sum(x == v for x in column) - 1) / 2 + 0.5
            assert math.isclose(got[i][k], round(2 * rank / len(rows) - 1, 4), abs_tol=1e-9)


# --- samples -----------------------------------------------------------------------------------------
def plain_spread(m, k):
    if k >= m:
        return list(range(m))
    top = math.ceil(k / 2)
    return [*range(top), *(top + int((i + 0.5) * (m - top) / (k - top)) for i in range(k - top))]


def plain_slots(sizes, total):
    base = [int(s > 0 and total >= len(sizes)) for s in sizes]
    left, pool = total - sum(base), [max(0, s - b) for s, b in zip(sizes, base)]
    if left <= 0 or not sum(pool):
        return base
    exact = [p * left / sum(pool) for p in pool]
    out = [min(p, int(x)) + b for p, x, b in zip(pool, exact, base)]
    for i in sorted(range(len(sizes)), key=lambda i: (-(exact[i] - int(exact[i])), i)):
        if sum(out) < total and out[i] < sizes[i]:
            out[i] += 1
    return out


def plain_sample(ranked, size, floor, share):
    """``ranked``: (id, stratum, in floor, hit), best first."""
    chosen = set()

    def fill(pool, n):
        strata = defaultdict(list)
        for t in pool:
            if t[0] not in chosen:
                strata[t[1]].append(t[0])
        keys = sorted(strata)
        for k, slots in zip(keys, plain_slots([len(strata[k]) for k in keys], n) if n > 0 else []):
            chosen.update(strata[k][i] for i in plain_spread(len(strata[k]), slots))

    inside = [t[0] for t in ranked if t[2]]
    chosen |= {inside[i] for i in plain_spread(len(inside), min(floor, size))}
    hits = [t for t in ranked if t[3]]
    fill(hits, max(0, min(min(size, int(share * size + 0.5)) - sum(t[0] in chosen for t in hits), size - len(chosen))))
    fill(ranked, size - len(chosen))
    return chosen


def test_samples_follow_the_rule_and_lie_in_one_another(spark):
    rng = random.Random(10)
    ranked = [(i, f"g{rng.randrange(4)}|d{rng.randrange(3)}", rng.random() < 0.1, rng.random() < 0.3) for i in range(500)]
    df = spark.createDataFrame(ranked, "track_id int, s string, il boolean, h boolean")
    args = (F.col("il"), F.col("h"), F.col("s"), [F.col("track_id").asc()])
    large, small = plain_sample(ranked, 120, 15, 0.8), None
    small = plain_sample([t for t in ranked if t[0] in large], 30, 5, 0.6)
    assert len(large) == 120 and len(small) == 30 and small < large
    assert {r.track_id for r in sample.stratified_sample(df, 120, 15, 0.8, *args).collect()} == large
    got = {r.track_id: r.level for r in sample.nested_samples(df, [(120, 15, 0.8), (30, 5, 0.6)], *args).collect()}
    assert set(got) == large and {t for t, k in got.items() if k == 1} == small
