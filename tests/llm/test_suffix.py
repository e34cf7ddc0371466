import hashlib
import random
from itertools import groupby

import numpy as np
import pytest

from cratewise.llm import suffix
from cratewise.llm.queries import op3_suffix_dedup


def plain(docs):
    """doc_id -> (n_bytes, n_removed, n_spans, kept) by looking at every string of 100 bytes."""
    seen, out = set(), {}
    for doc_id in sorted(docs):
        data = (docs[doc_id] or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), int(gone.sum()), sum(g for g, _ in groupby(gone.tolist())), hashlib.sha256(kept).hexdigest())
    return out


def result(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def odd_documents():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line, short = text(60), text(30), "Licensed under the same sentence as all others."
    docs = {0: None, 1: "", 2: "x" * 99, 3: "x" * 100, 4: "x" * 150, 5: "ab" * 400, 6: text(3000), 7: passage, 8: passage, 9: passage + "!"}
    for i in range(10, 60):
        parts = [text(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 5))]
        for p in (passage, line, short, passage[20:130], passage[60:], "\0" * 40 + line):
            if rng.randrange(3) == 0:
                parts.insert(rng.randrange(len(parts) + 1), p)
        docs[i] = rng.choice([" ", "\n", ""]).join(parts)
    docs[60] = docs[30] + docs[31] + docs[30]
    docs[61], docs[62] = docs[40], docs[40][:-1] + "?"
    for i in range(70, 90):  # near copies
        near = list(docs[6])
        for _ in range(i % 9):
            near[rng.randrange(len(near))] = "#"
        docs[i] = "".join(near)
    return docs


@pytest.mark.parametrize("frequent, remembered, sort", [(2_000, 40_000, 30_000), (3, 50, 100)])
def test_equals_brute_force(spark, docs_of, folder_of, monkeypatch, frequent, remembered, sort):
    monkeypatch.setattr(suffix, "FREQUENT", frequent)
    monkeypatch.setattr(suffix, "REMEMBERED", remembered)
    monkeypatch.setattr(suffix, "SORTED", sort)
    docs = odd_documents()
    rows = [*docs.items(), (None, "x" * 300), (8, docs[8])]
    random.Random(0).shuffle(rows)
    want = plain(docs)
    assert result(op3_suffix_dedup(spark, folder_of(documents=docs_of(rows))).collect()) == want
    assert sum(w[1] for w in want.values()) > 50_000


def test_given_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert result(op3_suffix_dedup(spark, "/root/testdata/sf0.001").collect()) == plain(docs)


def test_no_documents(spark, docs_of):
    assert suffix.remove_repeats(docs_of([])).count() == 0
    assert suffix.remove_repeats(docs_of([(1, None)])).collect() == [(1, 0, 0, 0, bytearray(b""))]


def test_interval_tree():
    # suffix array of "banana": a ana anana banana na nana
    assert list(suffix.intervals([0, 1, 3, 0, 0, 2])) == [(3, 1, 2), (1, 0, 2), (2, 4, 5)]


def test_maximal_groups_have_all_occurrences():
    """Contexts of one anchor: groups as left-diverse and right-diverse sets, by brute force."""
    rng = random.Random(8)
    kmer = b"k" * 32
    rows = []
    for i in range(14):
        left = bytes(rng.choice(b"ab") for _ in range(3)) + b"L" * rng.choice([40, 60])
        right = b"R" * rng.choice([10, 30, 68]) + bytes(rng.choice(b"cd") for _ in range(3))
        rows.append((left[-68:], (kmer + right)[:100]))
    rows = sorted(set(rows))
    n = len(rows)
    c = suffix.Contexts(np.zeros(n, np.int64), np.arange(n), np.full(n, 68), np.array([len(a) for a, _ in rows]), [a + b for a, b in rows])
    where = {int(d): p for p, d in enumerate(c.doc)}

    def lcp(a, b):
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return k

    want = set()
    for i in range(n):
        for j in range(i):
            left, right = lcp(rows[i][0][::-1], rows[j][0][::-1]), lcp(rows[i][1], rows[j][1])
            if left + right >= 100:
                all_of = frozenset(where[m] for m in range(n) if lcp(rows[m][0][::-1], rows[i][0][::-1]) >= left and lcp(rows[m][1], rows[i][1]) >= right)
                want.add((all_of, left, right))
    found = [(frozenset(p.tolist()), left, right) for p, left, right in c.groups()]
    assert len(found) == len(set(found)) and set(found) <= want
    for i, j in ((i, j) for i in range(n) for j in range(i)):  # every pair's passage lies in a group that holds both
        left, right = lcp(rows[i][0][::-1], rows[j][0][::-1]), lcp(rows[i][1], rows[j][1])
        if left + right >= 100:
            assert any({where[i], where[j]} <= g and a >= left and b >= right for g, a, b in found)


def test_every_window_has_an_anchor():
    data = np.frombuffer(random.Random(1).randbytes(3_000) + b"z" * 300, np.uint8)
    at, _ = suffix.anchors(data)
    assert all(((at >= p) & (at <= p + 68)).any() for p in range(len(data) - 99))
