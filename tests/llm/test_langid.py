import zlib
from itertools import product

import numpy as np
import pytest

from cratewise.llm import langid
from cratewise.llm.queries import op2_language_id

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    from cratewise.llm.queries import language_model

    return language_model(spark, FOLDER)


def test_held_out_accuracy(spark):
    rows = op2_language_id(spark, FOLDER).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.99


def test_labels_of_predicted_documents_do_not_matter(spark, folder_of):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    from cratewise.llm.queries import held_out
    from pyspark.sql import functions as F

    a = op2_language_id(spark, folder_of(documents=docs)).drop("spans").collect()
    changed = docs.withColumn("lang", F.when(held_out(4, 2), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("y"))
    assert sorted(op2_language_id(spark, folder_of(documents=changed)).drop("spans").collect()) == sorted(a)


def test_mixed_text_has_spans(model):
    fr, en = "les queues pour une étoile dans elle qui est de la mentaire ", "the thing with that is of and another thion there "
    (lang, score, spans), = model.predict([en * 9 + fr * 4])
    assert lang == "en" and 0.5 < score < 1
    assert [model.languages[s[3]] for s in spans] == ["en", "fr"]
    assert sum(s[1] for s in spans) == len(langid.words_of(en * 9 + fr * 4))


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(0)
    scores, start = rng.normal(0, 9, (7, 3)).astype(np.float32), np.zeros(3, np.float32)
    table = rng.integers(0, 7, (6, 4))
    path = langid.viterbi(scores, table, start)
    for k in range(4):
        cost = lambda p: sum(scores[table[t, k], p[t]] for t in range(6)) - langid.SWITCH * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert cost(path[:, k]) == pytest.approx(max(cost(p) for p in product(range(3), repeat=6)), abs=1e-4)


def test_edge_cases(spark, docs_of, model):
    rows = [(1, None), (2, ""), (3, "123 !!! ²"), (4, "Привет мир"), (5, "the " * 50_000), (6, "x"), (6, "w"), (None, "y")]
    got = {r.doc_id: r for r in langid.identify(docs_of(rows), model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    assert [(got[i].lang_pred, got[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[5].lang_pred == "en" and got[5].spans[0].words == 50_000
    assert got[4].lang_pred in model.languages
    assert langid.identify(docs_of([]), model).count() == 0
    nothing = langid.fit(docs_of([]))
    assert [r.lang_pred for r in langid.identify(docs_of([(1, "text")]), nothing).collect()] == ["und"]


def test_script_narrows_candidates(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("мир да война", "ru"), ("the war and peace", "en"), ("la guerre et la paix", "fr"), (None, "de"), ("no label", None)] * 3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr", "ru"]
    assert model.predict(["ывап the peace"])[0][2][0][3] == 2
    assert model.word_scores(["ыва"])[0].argmax() == 2


def test_every_label_is_learned(spark):
    rows = [(k * 3 + j, f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}word{chr(97 + k % 26) * 3} other{chr(97 + k // 26)} ", f"l{k:03d}") for k in range(300) for j in range(3)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({r[2] for r in rows}) and len(model.languages) == 300
