"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of each. Every distinct fingerprint is
sent to each cell (leading bits of a variant) that holds a variant of it; in its cell it emits its variants, and
fingerprints that share one are linked. All that share a variant are within 2r of one another, so each is linked to
the first of them alone, and a cell returns a spanning forest instead of pairs. Cells that would hold too many
variants are dealt out by further bits before any task gathers them.

A null or empty text, or one of white space only, has fingerprint zero and is linked like any other. Repeated texts
share a fingerprint, so they are in one component. Texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from cratewise.llm.common import documents, offsets_of, slices, texts
from cratewise.llm.graph import components
from cratewise.session import fixed

BITS = 64
SHINGLE_WORDS = 4
SEED = 42
#: Variants that a cell is to hold, and those above which it is dealt out by further bits.
CELL_VARIANTS, MOST_VARIANTS = 4_000_000, 32_000_000
#: Bits by which a cell that is too large is dealt out.
FURTHER_BITS = 6
#: Variants that a task holds at a time.
HELD_VARIANTS = 2_000_000


def fingerprints_of(all_texts: list[str]) -> np.ndarray:
    """SimHash of each text over its word shingles, as unsigned 64-bit integers."""
    digest = partial(xxh64_intdigest, seed=SEED)
    hashes, counts = [], []
    for text in all_texts:
        words = text.encode().lower().split()  # of bytes: A-Z, and the six white-space characters
        if len(words) > SHINGLE_WORDS:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS))))
        else:
            shingles = [b" ".join(words)] if words else []
        n = len(hashes)
        hashes.extend(map(digest, shingles))
        counts.append(len(hashes) - n)
    out = np.zeros(len(all_texts), np.uint64)
    h, n = np.array(hashes, np.uint64), np.array(counts, np.int64)
    some = np.flatnonzero(n)
    if len(some):
        starts = offsets_of(n)[some]
        ones = np.zeros((len(some), BITS), np.int64)
        planes = h.view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(np.unpackbits(planes[:, byte : byte + 1], axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of each document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(texts(batch)).view(np.int64))], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(task, "doc_id long, fingerprint long")


def _masks(bits: int, most: int) -> list[np.ndarray]:
    """For f = 0..most: all masks of up to f of the low ``bits`` bits."""
    by = [[sum(1 << b for b in c) for c in combinations(range(bits), k)] for k in range(most + 1)]
    return [np.array(sum(by[: f + 1], []), np.uint64) for f in range(most + 1)]


def _ball(bits: int, flips: int) -> int:
    return sum(math.comb(bits, k) for k in range(flips + 1))


def meet(prints: np.ndarray, flips: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of two fingerprints) through shared variants of the low ``bits`` bits; flips: how many bits of each
    may still change. The leading bits count as equal."""
    total = sum(int((flips == f).sum()) * _ball(bits, f) for f in range(radius + 1))
    none = np.zeros(0, np.int64)
    if len(prints) < 2:
        return none, none
    if total > HELD_VARIANTS and bits:
        one = (prints >> np.uint64(bits - 1)) & np.uint64(1) == 1
        found = []
        for side in (one, ~one):  # variants with this bit set, and not
            mine = np.flatnonzero(side | (flips > 0))
            a, b = meet(prints[mine], flips[mine] - ~side[mine], bits - 1, radius)
            found.append((mine[a], mine[b]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    low = prints & np.uint64((1 << bits) - 1)
    masks = _masks(bits, radius)
    owners = [np.flatnonzero(flips == f) for f in range(radius + 1)]
    variants = np.concatenate([(low[o, None] ^ masks[f]).ravel() for f, o in enumerate(owners)])
    ordered = np.sort(variants)
    shared = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(shared):
        return none, none
    size = np.uint64((1 << 22) - 1)
    mixed = lambda v: (v ^ (v >> np.uint64(22)) ^ (v >> np.uint64(43))) & size
    seen = np.zeros(1 << 22, bool)
    seen[mixed(shared)] = True
    may = np.flatnonzero(seen[mixed(variants)])
    owner = np.concatenate([np.repeat(o, len(masks[f])) for f, o in enumerate(owners)])[may]
    order = np.lexsort((owner, variants[may]))
    value, owner = variants[may][order], owner[order]
    first = np.append(True, value[1:] != value[:-1])
    heads = owner[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    links = np.unique(heads[~first] * len(prints) + owner[~first])
    return links // len(prints), links % len(prints)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the smallest place that links lead to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]


def links(prints: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``prints`` (fingerprint, first: a node id) into the components that
    linking every two within ``distance`` bits would. distance is even."""
    radius = distance // 2
    n = prints.count()
    bits = min(max(math.ceil(math.log2(max(n, 1) * _ball(BITS, radius) / CELL_VARIANTS)), 1), 24)
    cells = _deal(prints.select("fingerprint", "first", F.lit(0).cast("long").alias("cell"), F.lit(radius).alias("flips")), 0, bits, radius)
    parts, done = [], bits
    while True:
        weight = F.element_at(F.array(*(F.lit(_ball(BITS - done, f)) for f in range(radius + 1))), F.col("flips") + 1)
        large = [r.cell for r in cells.groupBy("cell").agg(F.sum(weight).alias("w")).where(F.col("w") > MOST_VARIANTS).select("cell").take(1)] if done + FURTHER_BITS <= 62 else []
        if not large:
            parts.append(_linked(cells, BITS - done, radius, distance))
            break
        sizes = fixed(cells.groupBy("cell").agg(F.sum(weight).alias("w")).where(F.col("w") > MOST_VARIANTS).select("cell"))
        parts.append(_linked(cells.join(sizes, "cell", "left_anti"), BITS - done, radius, distance))
        cells = fixed(_deal(cells.join(sizes, "cell", "left_semi"), done, FURTHER_BITS, radius))
        done += FURTHER_BITS
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def _deal(rows: DataFrame, done: int, bits: int, radius: int) -> DataFrame:
    """Each row once for every value of the next ``bits`` bits that its variants can have."""
    steps = [(m, f) for f in range(radius + 1) for m in (sum(1 << b for b in c) for c in combinations(range(bits), f))]
    step = F.explode(F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(f).alias("used")) for m, f in steps))).alias("step")
    own = F.shiftrightunsigned("fingerprint", BITS - done - bits).bitwiseAND(F.lit((1 << bits) - 1))
    return (
        rows.select("*", step).where(F.col("step.used") <= F.col("flips"))
        .select("fingerprint", "first", (F.shiftleft("cell", bits) + own.bitwiseXOR(F.col("step.mask"))).alias("cell"), (F.col("flips") - F.col("step.used")).alias("flips"))
    )


def _linked(cells: DataFrame, bits: int, radius: int, distance: int) -> DataFrame:
    def task(table: pa.Table) -> pa.Table:
        prints = table.column("fingerprint").to_numpy().view(np.uint64)
        node = table.column("first").to_numpy()
        order = np.argsort(node)
        prints, node = prints[order], node[order]
        a, b = meet(prints, table.column("flips").to_numpy().astype(np.int64)[order], bits, radius)
        near = np.bitwise_count(prints[a] ^ prints[b]) <= distance  # always so; the exact check costs little
        label = forest(a[near], b[near], len(prints))
        led = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": node[led], "b": node[label[led]]})

    return cells.groupBy("cell").applyInArrow(task, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id): documents are linked whose fingerprints differ in at
    most ``distance`` bits; component_id is the smallest doc_id reachable, its own if there is no other."""
    prints = fixed(fingerprints(docs))
    distinct = fixed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, distance))
    classes = distinct.join(found, F.col("first") == F.col("node"), "left").select("fingerprint", F.coalesce("component", "first").alias("component_id"))
    return prints.join(classes, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
