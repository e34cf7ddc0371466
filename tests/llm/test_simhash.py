import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from cratewise.llm import graph, simhash
from cratewise.llm.queries import op6_simhash_near_dedup


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    """prints: id -> fingerprint."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, x in prints.items():
            for j, y in prints.items():
                if (x ^ y).bit_count() <= distance and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def test_small_documents(spark, docs_of, folder_of):
    rng = random.Random(1)
    base = [rng.choice("alpha Beta gamma delta epsilon zeta Éta".split()) + str(rng.randrange(40)) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one  TWO"), (5, "a b c d"), (6, "É é x y z"), (7, "é é x y z")]
    for k in range(60):
        words = base[:]
        for _ in range(k % 7):
            words[rng.randrange(400)] = f"w{k}"
        rows.append((10 + k, " ".join(words)))
    rows.append((100, "long " * 30_000 + "tail"))
    got = {r.doc_id: r for r in op6_simhash_near_dedup(spark, folder_of(documents=docs_of([*rows, rows[5], (None, "x")]))).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in prints.items()}
    want = plain_components(prints, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(rows) - 20


@pytest.mark.parametrize("limits", [(4_000_000, 32_000_000, 2_000_000), (3_000, 20_000, 500)])
def test_links_equal_brute_force(spark, monkeypatch, limits):
    """The second limits force further dealing of cells and splitting inside them."""
    for name, value in zip(("CELL_VARIANTS", "MOST_VARIANTS", "HELD_VARIANTS"), limits):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(2)
    prints = {0: 0, 1: 2**64 - 1}
    for centre in [rng.getrandbits(64) for _ in range(4)] + [0]:
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randrange(9)):
                x ^= 1 << b
            prints[len(prints)] = x
    unique = {x: i for i, x in reversed(prints.items())}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for x, i in unique.items()], "fingerprint long, first long")
    found = {r.node: r.component for r in graph.components(simhash.links(df, 4)).collect()}
    want = plain_components({i: x for x, i in unique.items()}, 4)
    assert {i: found.get(i, i) for i in want} == want


def test_no_documents(spark, docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_chain_of_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    assert sorted(graph.components(chain).collect()) == [(i, 0) for i in range(1, 201)] + [(501, 500)]


def test_forest():
    assert simhash.forest(np.array([0, 1, 5]), np.array([1, 2, 6]), 8).tolist() == [0, 0, 0, 3, 4, 5, 5, 7]
