import random
import re
from collections import Counter, defaultdict

import duckdb

from cratewise.llm import audit
from cratewise.llm.queries import OP13_SQL, op13_source_audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = re.compile("[A-Z]")


def plain(rows):
    """The result by the rule, over all terms and pairs."""
    df, tf, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [SMALL.sub(lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        df[lang].update(set(words))
        tf[lang, source].update(words)
        groups.add((lang, source))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= 30]
        sources = [s for x, s in groups if x == lang]
        counts = {s: tf[lang, s] for s in sources} | {None: sum((tf[lang, s] for s in sources), Counter())}
        p = {}
        for s, c in counts.items():
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 1_000_000_000 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted(((p[None][t] - p[s][t], t) for t in kept if counts[s][t] and p[s][t] > p[None][t]), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", t, -v, k + 1) for k, (v, t) in enumerate(terms[:50])]
    return sorted(out)


def made(seed=4, n=900):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "Haus", "é", "日本", "Ünder", "ünder"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "a", "a", "b", "c", "ü", None, f"s{rng.randrange(4)}"])
        k = rng.choice([0, 3, 30, 60])
        rows.append((i if rng.random() < 0.9 else rng.choice([None, 1]), " 1, ".join(rng.choices(words, weights=range(len(words), 0, -1), k=k)), lang, source))
    return [*rows, (5, None, "fr", "x"), (5, "une deux", "fr", "y"), (6, "alone", "it", None), (7, "-- 12", None, "only"), (8, "x" * 100_000 + " the " * 20_000, "en", "long")]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, lang string, source string, n long, term string")


def listed(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def test_equals_the_rule_and_the_sql(spark, folder_of, tmp_path):
    rows = made()
    folder = folder_of(documents=table_of(spark, rows))
    got = listed(op13_source_audit(spark, folder))
    assert got == plain(rows) and {"pair", "term"} == {r[2] for r in got}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    assert sorted(con.execute(OP13_SQL).fetchall()) == [(*r[:4], r[4], r[5]) for r in got]


def test_small_blocks_and_shards_change_nothing(spark, monkeypatch):
    """Runs that spill after every slice, merged in many shards."""
    rows = made(9, 300)
    table = table_of(spark, rows)
    want = listed(audit.divergences(table))
    assert want == plain(rows)
    monkeypatch.setattr(audit, "SHARD_BYTES", 1_000)
    assert listed(audit.divergences(table.repartition(9))) == want


def test_runs_of_one_shard_are_merged_in_order(spark):
    rows = made(3, 200)
    batches = [r for r in audit.runs(table_of(spark, rows).na.fill("").repartition(5), 1).toArrow().to_batches()]
    langs = [b.column("lang")[0].as_py() for b in audit.merged(iter(batches))]
    assert langs == sorted(langs)
    out = next(b for b in audit.merged(iter(batches)) if b.column("lang")[0].as_py() == "en")
    counts = Counter()
    for _, text, lang, source in rows:
        if (lang or "") == "en":
            counts.update(w.lower() for w in TERM.findall(text or "") if w.lower() == "the")
    at = [k for k, (x, t) in enumerate(zip(out.column("lang").to_pylist(), out.column("term").to_pylist())) if (x, t) == ("en", "the")]
    assert [out.column("total")[k].as_py() for k in at] == [counts["the"]]


def test_no_rows(spark):
    assert audit.divergences(table_of(spark, [])).collect() == []
