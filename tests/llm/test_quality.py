import zlib

import numpy as np
import pytest

from cratewise.llm import quality
from cratewise.llm.queries import op9_quality_fm

FOLDER = "/root/testdata/sf0.01"


def test_held_out_labels(spark):
    rows = {r.doc_id: r for r in op9_quality_fm(spark, FOLDER).collect()}
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    held = [(rows[x.doc_id].score, x.quality) for x in spark.read.parquet(f"{FOLDER}/labels.parquet").collect() if rows[x.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([s >= 0.3 for s in good]) > 0.98


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(1)
    model = quality.Model(0.3, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, quality.FACTORS)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS), np.tile(np.linspace(0, 5, quality.BINS - 1), (quality.STATISTICS, 1)))
    places, values, starts, stats = quality.features(["a few words, a few", "", "MORE words!! 12"])
    raw, _ = model.sums(places, values, starts, stats)
    own, x = model.dense(stats)
    for t in range(3):
        at = np.concatenate([own[t], places[starts[t] : starts[t + 1]]])
        v = np.concatenate([x[t], values[starts[t] : starts[t + 1]]])
        pairs = sum(model.factor[at[i]] @ model.factor[at[j]] * v[i] * v[j] for i in range(len(at)) for j in range(i))
        assert raw[t] == pytest.approx(0.3 + model.weight[at] @ v + pairs)


def test_edge_cases(spark, docs_of, folder_of):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "word " * 40_000), (5, "ok"), (5, "ok"), (6, "É | $$$"), (None, "x")]
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (4, 0, 0), (3, None, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in op9_quality_fm(spark, folder_of(documents=docs_of(rows), labels=labels)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and all(0 <= s <= 1 for s in got.values()) and got[1] == got[2]
    assert {r.score for r in quality.score(docs_of(rows), quality.fit(docs_of(rows), labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs_of([]), None).count() == 0


def test_training_repeats_itself():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "fine", "BAD!!", "WORSE$$"], 30, p=[0.45, 0.45, 0.05, 0.05] if k % 2 else [0.05, 0.05, 0.45, 0.45])) for k in range(120)]
    labels = np.arange(120) % 2.0
    a, b = (quality.train(*quality.features(texts), labels).scores(texts) for _ in range(2))
    assert (a == b).all() and ((a > 0.5) == (labels > 0)).all()
