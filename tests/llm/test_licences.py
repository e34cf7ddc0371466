import math

from cratewise.llm import licences
from cratewise.llm.queries import op7_licence_scan


def plain_own(files):
    """doc_id -> (licence, score) by comparing every passage with every template."""
    n = len(files)
    df = {t: sum(t in licences.terms(x or "") for x in files.values()) for _, text in licences.TEMPLATES for t in licences.terms(text)}
    idf = lambda t: math.log((1 + n) / (1 + df[t]) * math.e) if t in df else math.log((1 + n) / 2 * math.e)
    vector = lambda text: {t: c * idf(t) for t, c in licences.terms(text).items()}
    out = {}
    for i, text in files.items():
        for passage in (text or "").split("\n"):
            v = vector(passage)
            for name, template in licences.TEMPLATES:
                w = vector(template)
                dot = sum(v.get(t, 0) * x for t, x in w.items())
                size = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
                score = round(dot / size, 9) if size else 0
                if score >= licences.THRESHOLD and (-score, name) < out.get(i, (0, "")):
                    out[i] = (-score, name)
    return {i: (name, -s) for i, (s, name) in out.items()}


def test_scan_and_inheritance(spark):
    texts = {1: "Licensed under the Apache License, Version 2.0.", 2: "code here\nmore code", 3: None, 4: "", 5: "prose first\nLicensed under CC BY-NC 4.0.\nlong prose that goes on for a while after that line",
             6: "All rights reserved.", 7: "other words", 8: "word " * 30_000, 9: "This work is licensed under the GNU General Public License, version 3.", 10: "Unlicensed animals licensed rights", 11: "x"}
    paths = {1: "a/LICENSE", 2: "a/src/x.py", 3: "a/src/deep/y.py", 4: "b/z.py", 5: "a/src/t.md", 6: "a/src/deep/COPYING", 7: "a/src/deep/er/q", 8: "top", 9: "c/LICENSE", 10: "b/v", 11: None}
    rows = [(i, paths[i], t, "clash") for i, t in texts.items()] + [(2, paths[2], texts[2], "again"), (None, "a/n", "x", "")]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string")
    got = {r.doc_id: r for r in licences.scan(files).collect()}
    assert set(got) == set(texts)
    own = plain_own(texts)
    assert {i: (r.licence, r.score) for i, r in got.items() if r.score is not None} == own
    assert {i: (r.licence, r.via, r.directory) for i, r in got.items()} == {
        1: ("Apache-2.0", "licence file", None), 2: ("Apache-2.0", "inherited", "a"), 3: ("Proprietary", "inherited", "a/src/deep"), 4: (None, None, None), 5: ("CC-BY-NC-4.0", "header", None),
        6: ("Proprietary", "licence file", None), 7: ("Proprietary", "inherited", "a/src/deep"), 8: (None, None, None), 9: ("GPL-3.0", "licence file", None), 10: (None, None, None), 11: (None, None, None)}
    assert licences.scan(files.limit(0)).count() == 0


def test_given_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op7_licence_scan(spark, folder).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: (r.licence, r.score) for r in got if r.score is not None} == plain_own(texts)
    assert any(r.via == "header" for r in got)
