"""Source divergence audit by single-pass in-memory indexing.

A task counts the terms of its documents in a block in memory. When the block is full it is spilled as a run: for every hash
shard and language one row with its terms in sorted order and their postings (sources and occurrences). Runs meet in their
shard, where a heap merges them term by term into frequencies; a language's kept terms leave it, one row a term.

Divergences are sums over all kept terms, of which most do not occur in a given source. A pair of sources is first taken as if
no term occurred in either, corrected by the terms of each alone (by the histogram of its counts), and then by the terms
that both have, which are streamed: a task adds up the corrections of all pairs that its terms' postings hold, and gives one
row a pair.

Every row is a document: ids are neither read nor needed, and repeated rows count each. Null text, lang and source are ''. A
text without terms still makes its group known. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.llm.common import slices, texts
from cratewise.session import fixed

#: Documents of a language that a kept term stands in, at least.
KEPT_IN = 30
#: Terms of the part ``term`` a group, and the parts of a thousand million that probabilities are counted in.
TERMS, UNIT, PRIOR = 50, 1_000_000_000, 5
#: Postings that a task holds in memory before it spills a run.
BLOCK_POSTINGS = 600_000
#: Bytes of text a hash shard, on average.
SHARD_BYTES = 48 << 20
#: Pairs of sources, and postings, that a task adds up at a time.
OPEN_PAIRS, STREAMED = 200_000, 200_000
#: Letters of a term: all that is not ASCII, and ASCII letters in lower case; other bytes part terms.
_LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_RUN = "shard int, lang string, terms array<binary>, documents array<long>, ends array<int>, sources array<string>, source_of array<int>, counts array<long>"
_RUN_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("documents", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
    ("sources", pa.list_(pa.string())), ("source_of", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])
_KEPT_SCHEMA = pa.schema([("lang", pa.string()), ("term", pa.string()), ("total", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def runs(docs: DataFrame, shards: int) -> DataFrame:
    """The spilled runs of the tasks: a row for each shard and language of a run."""

    def spill(occurrences: dict[str, dict[str, Counter]], documents: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, by_source in occurrences.items():
            terms = sorted(documents[lang])
            shard_of = np.fromiter((crc32(t, crc32(lang.encode())) for t in terms), np.int64, len(terms)) % shards
            order = np.argsort(shard_of, kind="stable")  # by shard, then term
            place = dict(zip((terms[k] for k in order.tolist()), range(len(terms))))
            names = sorted(by_source)
            at = np.concatenate([np.fromiter(map(place.__getitem__, by_source[s]), np.int64, len(by_source[s])) for s in names])
            counts = np.concatenate([np.fromiter(by_source[s].values(), np.int64, len(by_source[s])) for s in names])
            source_of = np.repeat(np.arange(len(names), dtype=np.int32), [len(by_source[s]) for s in names])
            posted = np.argsort(at, kind="stable")
            counts, source_of, ends = counts[posted], source_of[posted], np.cumsum(np.bincount(at, minlength=len(terms)))
            listed, shard_of = list(place), shard_of[order]
            in_documents = np.fromiter(map(documents[lang].__getitem__, listed), np.int64, len(listed))
            for first, last in zip(*_groups(shard_of)):
                start, end = (ends[first - 1] if first else 0), ends[last - 1]
                row = (shard_of[first], lang, listed[first:last], in_documents[first:last], ends[first:last] - start, names, source_of[start:end], counts[start:end])
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _RUN_SCHEMA)], schema=_RUN_SCHEMA)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
        documents: dict[str, Counter] = defaultdict(Counter)
        for batch in slices(batches):
            for text, lang, source in zip(texts(batch), batch.column("lang").to_pylist(), batch.column("source").to_pylist()):
                words = terms_of(text)
                if words:
                    occurrences[lang][source].update(words)
                documents[lang].update(set(words))
            if sum(len(counted) for by_source in occurrences.values() for counted in by_source.values()) > BLOCK_POSTINGS:
                yield from spill(occurrences, documents)
                occurrences.clear()
                documents.clear()
        yield from spill(occurrences, documents)

    return docs.mapInArrow(task, _RUN)


def _groups(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Where runs of equal keys start and end."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return [0, *cuts.tolist()], [*cuts.tolist(), len(keys)]


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The kept terms of a shard: its runs, term by term, by a heap."""
    by_lang: dict[str, list] = defaultdict(list)
    for batch in batches:
        for k, lang in enumerate(batch.column("lang").to_pylist()):
            number = lambda c: batch.column(c)[k].values.to_numpy()  # noqa: B023, E731
            by_lang[lang].append((batch.column("terms")[k].as_py(), number("documents").tolist(), number("ends"), batch.column("sources")[k].as_py(), number("source_of"), number("counts")))
    for lang in sorted(by_lang):
        found, documents, last = [], [], None
        number_of = [[0] * len(run[0]) for run in by_lang[lang]]
        for term, run, k in heapq.merge(*(zip(of_run[0], repeat(r), range(len(of_run[0]))) for r, of_run in enumerate(by_lang[lang]))):
            if term != last:
                last = term
                found.append(term)
                documents.append(0)
            documents[-1] += by_lang[lang][run][1][k]
            number_of[run][k] = len(found) - 1
        kept = np.array(documents, np.int64) >= KEPT_IN
        if not kept.any():
            continue
        place: dict[str, int] = {}
        keys, sums = [], []
        for numbers, (_, _, ends, sources, source_of, counts) in zip(number_of, by_lang[lang]):
            of_posting = np.repeat(np.array(numbers, np.int64), np.diff(ends, prepend=0))
            mine = kept[of_posting]
            source = np.array([place.setdefault(s, len(place)) for s in sources], np.int64)[source_of[mine]]
            keys.append(of_posting[mine] << 32 | source)
            sums.append(counts[mine])
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.zeros(len(key), np.int64)
        np.add.at(count, at, np.concatenate(sums))
        names, term_of, source = list(place), key >> 32, (key & 0xFFFFFFFF).tolist()
        count = count.tolist()
        rows = [(lang, found[term_of[a]].decode(), sum(count[a:b]), [names[k] for k in source[a:b]], count[a:b]) for a, b in zip(*_groups(term_of))]
        for start in range(0, len(rows), 5_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 5_000]), _KEPT_SCHEMA)], schema=_KEPT_SCHEMA)


def frequencies(docs: DataFrame) -> DataFrame:
    """(lang, term, total, sources, counts) of each language's kept terms."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = int(size // SHARD_BYTES) + 8
    held = fixed(runs(docs, shards))

    def shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merged(batches)

    return fixed(held.repartition(shards, "shard").groupBy("shard").applyInArrow(shard, "lang string, term string, total long, sources array<string>, counts array<long>"))


def _p(count, n, v):
    return F.lit(1).cast("long") + F.expr(f"({UNIT}L * ({count} + {PRIOR})) div ({n} + {PRIOR} * {v})")


def corrections(kept: DataFrame) -> DataFrame:
    """(lang, one, other, value) of pairs of sources, one < other, that share terms: what their sum over kept terms has to be
    changed by for the terms that both have. ``kept``: (lang, term, postings of (source, p, p0)) of terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: Counter[tuple[str, str, str]] = Counter()

        def closed() -> pa.RecordBatch:
            columns = [*zip(*open_)] or [(), (), ()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(open_.values(), pa.int64())], ["lang", "one", "other", "value"])

        for batch in batches:
            for lang in pc.unique(batch.column("lang")).to_pylist():
                part = batch.filter(pc.equal(batch.column("lang"), lang)).column("postings")
                sizes, flat = pc.list_value_length(part).to_numpy(), part.flatten()
                names, places = np.unique(flat.field("source").to_numpy(zero_copy_only=False).astype(object), return_inverse=True)
                p, p0 = flat.field("p").to_numpy(), flat.field("p0").to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((places, owner))
                places, p, p0 = places[order], p[order], p0[order]
                # The postings k apart in a term's list: each pair of the list once, for all terms at once.
                for k in range(1, int(sizes.max(initial=0))):
                    i = np.flatnonzero(owner[k:] == owner[:-k])
                    j = i + k
                    value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                    pairs, at = np.unique(places[i] * len(names) + places[j], return_inverse=True)
                    sums = np.zeros(len(pairs), np.int64)
                    np.add.at(sums, at, value)
                    for pair, total in zip(pairs.tolist(), sums.tolist()):
                        open_[lang, names[pair // len(names)], names[pair % len(names)]] += total
                    if len(open_) > OPEN_PAIRS:
                        yield closed()
                        open_.clear()
        yield closed()

    parts = kept.select("lang", "postings").mapInArrow(task, "lang string, one string, other string, value long")
    return parts.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): how the word use of each source of a language differs from the language's other
    sources (part ``pair``), and the terms that it uses most above the language (part ``term``)."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    known = fixed(read.select("lang", "source").distinct())
    kept = frequencies(read)
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("n_lang"))
    posting = kept.select("lang", "term", "total", F.explode(F.arrays_zip("sources", "counts")).alias("x")).select("lang", "term", "total", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    histogram = fixed(posting.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("terms")))
    own = histogram.groupBy("lang", "source").agg(F.sum(F.col("count") * F.col("terms")).alias("n"), F.sum("terms").alias("distinct"))
    groups = known.join(sizes, "lang", "left").join(own, ["lang", "source"], "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("v", "n_lang", "n", "distinct")))
    groups = fixed(groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "n", "v")).otherwise(0)))

    of_group = groups.select("lang", "source", "n", "v", "n_lang", "p0")
    used = posting.join(of_group, ["lang", "source"]).withColumn("p", _p("count", "n", "v"))
    more = used.withColumn("value", F.col("p") - _p("total", "n_lang", "v")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    term = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TERMS).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    shared = used.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings")).where(F.size("postings") > 1)
    both = fixed(corrections(shared))
    # Of a source alone, against each base value that other sources of its language have.
    bases = groups.select("lang", F.col("p0").alias("base")).distinct()
    alone = histogram.join(of_group, ["lang", "source"]).withColumn("p", _p("count", "n", "v")).join(bases, "lang")
    alone = alone.groupBy("lang", "source", "base").agg(F.sum(F.col("terms") * (F.abs(F.col("p") - F.col("base")) - F.abs(F.col("p0") - F.col("base")))).alias("more"))
    alone = fixed(alone)
    one = groups.select("lang", F.col("source").alias("one"), F.col("p0").alias("p1"), "v")
    two = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("p2"))
    pairs = one.join(two, "lang").where("one < other")
    for name, base in (("one", "p2"), ("other", "p1")):
        pairs = pairs.join(alone.select("lang", F.col("source").alias(name), F.col("base").alias(base), F.col("more").alias(f"of_{name}")), ["lang", name, base], "left")
    pairs = pairs.join(both, ["lang", "one", "other"], "left")
    pairs = fixed(pairs.select("lang", "one", "other", (F.col("v") * F.abs(F.col("p1") - F.col("p2")) + sum(F.coalesce(c, F.lit(0)) for c in ("of_one", "of_other", "value"))).alias("value")))
    each = pairs.union(pairs.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    by_value = Window.partitionBy("lang", "one").orderBy(F.desc("value"), "other")
    pair = each.select("lang", F.col("one").alias("source"), F.lit("pair").alias("part"), F.col("other").alias("item"), "value", F.row_number().over(by_value).alias("rank"))
    return pair.union(term)
