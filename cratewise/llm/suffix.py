"""Removal of repeated passages with an enhanced suffix array and its common-prefix interval tree.

A passage of LENGTH bytes that stands in two places has, in both, an anchor at the same offset: a KMER whose hash is the
least of those that start in some window of LENGTH bytes. Only suffixes that start at repeated anchors are sorted (a
sparse suffix array), in groups of one anchor hash, each with the context in which a passage of LENGTH can lie. The
common prefixes of neighbours give the interval tree by a stack scan. In each interval the contexts to the left are
sorted and scanned likewise: every subset that shares as much to the left as it can (what lies beyond differs) and more
than LENGTH in all, and that no deeper interval holds, is a maximal repeat group with all its occurrences. All but the
first occurrence of a group (smaller document, then smaller start) are removed.

Copies: whole documents that equal an earlier one are found by digest and never anchored. Occurrences whose contexts
are equal are resolved before the shuffle, within a task. Anchors that stand in very many places are dealt out by the
longer passages around them: of a passage of LENGTH, either SIDE_RIGHT bytes from the anchor on or SIDE_LEFT bytes
before it are shared.

Texts are UTF-8 bytes, null is empty; matches never cross documents; overlaps count. Texts shorter than LENGTH keep all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import documents, lean, release, slices, texts
from cratewise.session import fixed, shuffle_width

LENGTH = 100
KMER = 32
#: Bytes of context: a passage of LENGTH that holds the anchor reaches no farther.
LEFT, RIGHT = LENGTH - KMER, LENGTH
SIDE_RIGHT = 66
SIDE_LEFT = LENGTH - SIDE_RIGHT
#: Places from which an anchor is dealt out by longer passages.
FREQUENT = 2_000
#: Contexts that a task remembers to resolve equal ones, and those that it sorts at a time besides a whole group.
REMEMBERED, SORTED = 40_000, 30_000
_SEED = 0x9E3779B97F4A7C15
_SHUFFLED = "key long, doc_id long, pos int, ahead int, behind int, context binary"


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes; width is a power of two."""
    h, factor, have = data.astype(np.uint64) + np.uint64(1), _SEED, 1
    while have < width:
        h = h[:-have] * np.uint64(factor) + h[have:]
        factor = factor * factor % 2**64
        have *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over each ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = pick(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): every k-mer that is least in some window of LENGTH bytes, ties included."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = window_hashes(data, KMER)
    width = LENGTH - KMER + 1
    least = _sliding(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate((edge, least, edge)), width, np.maximum) == h)
    return at, h[at].view(np.int64)


def intervals(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of the common-prefix lengths (common[i]: of i-1 and i; common[0] is passed over): (length, first, last)
    of every interval of the tree below the root, inner ones first."""
    stack = [(0, 0)]
    for i in range(1, len(common) + 1):
        now = common[i] if i < len(common) else 0
        first = i - 1
        while now < stack[-1][0]:
            length, first = stack.pop()
            yield length, first, i - 1
        if now > stack[-1][0]:
            stack.append((now, first))


class Contexts:
    """Contexts in the order of the suffix array: by key, then the bytes from the anchor on, then those before it."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, pos: np.ndarray, ahead: np.ndarray, context: list[bytes]) -> None:
        m = len(key)
        size = np.array([len(c) for c in context], np.int64)
        flat = np.frombuffer(b"".join(context), np.uint8)
        start = np.cumsum(size) - size
        column = np.arange(RIGHT + 4)
        right = np.zeros((m, RIGHT + 4), np.uint8)
        behind = size - ahead
        inside = column < behind[:, None]
        right[inside] = flat[((start + ahead)[:, None] + column)[inside]]
        column = np.arange(LEFT + 4)
        left = np.zeros((m, LEFT + 4), np.uint8)  # nearest byte first
        inside = column < ahead[:, None]
        left[inside] = flat[((start + ahead - 1)[:, None] - column)[inside]]
        words = [*right.view(">u8").T, behind, *left.view(">u8").T, ahead]
        order = np.lexsort((pos, doc, *reversed(words), key))
        self.key, self.doc, self.pos = key[order], doc[order], pos[order]
        self.right, self.behind, self.left, self.ahead = right[order], behind[order], left[order], ahead[order]

    def _same_key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.key[a] == self.key[b]

    def common_right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(self._same_key(a, b), _common(self.right[a], self.behind[a], self.right[b], self.behind[b]), 0)

    def common_left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _common(self.left[a], self.ahead[a], self.left[b], self.ahead[b])

    def equal_runs(self) -> np.ndarray:
        """For each context the place of the first that equals it; that is the earliest occurrence."""
        n = len(self.key)
        if not n:
            return np.zeros(0, np.int64)
        a, b = np.arange(n - 1), np.arange(1, n)
        equal = self._same_key(a, b) & (self.behind[a] == self.behind[b]) & (self.ahead[a] == self.ahead[b]) & (self.right[a] == self.right[b]).all(axis=1) & (self.left[a] == self.left[b]).all(axis=1)
        return np.maximum.accumulate(np.where(np.append(False, equal), 0, np.arange(n)))

    def groups(self) -> Iterator[tuple[np.ndarray, int, int]]:
        """Maximal repeat groups: (places of the occurrences, bytes shared before the anchor, bytes shared from it on).
        Of equal contexts, the first stands for all."""
        first = self.equal_runs()
        sa = np.flatnonzero(first == np.arange(len(first)))
        if len(sa) < 2:
            return
        right = np.append(0, self.common_right(sa[:-1], sa[1:]))
        beside = np.append(0, self.common_left(sa[:-1], sa[1:])).tolist()
        left_rank = np.empty(len(sa), np.int64)
        left_rank[np.lexsort([self.ahead[sa], *reversed(list(self.left[sa].view(">u8").T))])] = np.arange(len(sa))
        for length, i, j in intervals(right.tolist()):
            if length < KMER:
                continue
            if j == i + 1:
                if beside[j] + length >= LENGTH:
                    yield sa[i : j + 1], beside[j], length
                continue
            members = np.arange(i, j + 1)
            members = members[np.argsort(left_rank[i : j + 1])]
            left = np.append(0, self.common_left(sa[members[:-1]], sa[members[1:]]))
            if int(left.max()) + length < LENGTH:
                continue
            for shared, a, b in _with_all(left.tolist()):
                if shared + length < LENGTH:
                    continue
                own = members[a : b + 1]
                low, high = int(own.min()), int(own.max())
                if int(right[low + 1 : high + 1].min()) == length:  # else a deeper interval holds them all
                    yield sa[own], shared, length

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """For each context how many bytes before the anchor, and from it on, lie in a passage that stands earlier."""
        first = self.equal_runs()
        copy = (first != np.arange(len(first))) & (self.ahead + self.behind >= LENGTH)
        before, after = np.where(copy, self.ahead, 0), np.where(copy, self.behind, 0)
        for places, left, right in self.groups():
            earliest = places[np.lexsort((self.pos[places], self.doc[places]))[0]]
            later = places[places != earliest]
            before[later] = np.maximum(before[later], left)
            after[later] = np.maximum(after[later], right)
        return before, after


def _with_all(common: list[int]) -> Iterator[tuple[int, int, int]]:
    """The intervals, and the root with the length that all share, if only zero."""
    yield from intervals(common)
    if min(common[1:]) == 0:
        yield 0, 0, len(common) - 1


def _common(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), np.minimum(a_size, b_size))


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [anchors(np.frombuffer(t.encode(), np.uint8)) for t in texts(batch)]
        ids = np.repeat(batch.column("doc_id").to_numpy(), [len(p) for p, _ in found])
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h for _, h in found])), pa.array(ids), pa.array(np.concatenate([p for p, _ in found]).astype(np.int32))], ["hash", "doc_id", "pos"])


def _mixed(key: int, passage: bytes) -> int:
    return int.from_bytes(_digest(key.to_bytes(8, "little", signed=True) + passage), "little", signed=True)


def _digest(data: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(data, digest_size=8).digest()


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of repeated anchors, of equal ones in the task the earliest alone; the others are resolved, their context
    null and ahead and behind what is covered."""
    held: dict[tuple[int, int, bytes], tuple[int, int, int]] = {}
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("ahead", pa.int32()), ("behind", pa.int32()), ("context", pa.binary())])

    def rows_of(done: list[tuple], release: bool) -> pa.RecordBatch:
        if release:
            for (key, ahead, context), (doc, pos, places) in held.items():
                if places < FREQUENT:
                    done.append((key, doc, pos, ahead, len(context) - ahead, context))
                    continue
                if len(context) - ahead >= SIDE_RIGHT:
                    done.append((_mixed(key, context[ahead : ahead + SIDE_RIGHT] + b">"), doc, pos, ahead, len(context) - ahead, context))
                if ahead >= SIDE_LEFT:
                    done.append((_mixed(key, context[ahead - SIDE_LEFT : ahead] + b"<"), doc, pos, ahead, len(context) - ahead, context))
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in slices(batches):
        done: list[tuple] = []
        for doc, text, places in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("places").to_pylist()):
            data = text.encode()
            for p in places:
                pos, ahead = p["pos"], min(p["pos"], LEFT)
                key = (p["hash"], ahead, data[pos - ahead : pos + RIGHT])
                now = held.get(key)
                if now is None:
                    held[key] = (doc, pos, p["n"])
                    continue
                later = max((doc, pos), now[:2])
                if later == now[:2]:
                    held[key] = (doc, pos, p["n"])
                if len(key[2]) >= LENGTH:
                    done.append((later[0] ^ later[1], *later, ahead, len(key[2]) - ahead, None))
        yield rows_of(done, len(held) > REMEMBERED)
    yield rows_of([], True)


def _covered_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, stop) covered, from rows sorted by key. Whole keys are sorted together."""
    names = ["doc_id", "start", "stop"]
    waiting: list[pa.RecordBatch] = []
    count = 0

    def solve(rows: pa.Table) -> pa.RecordBatch:
        c = Contexts(*(rows.column(x).to_numpy().astype(np.int64) for x in ("key", "doc_id", "pos", "ahead")), rows.column("context").to_pylist())
        before, after = c.covered()
        some = np.flatnonzero(before + after)
        return pa.RecordBatch.from_arrays([pa.array(c.doc[some]), pa.array(c.pos[some] - before[some]), pa.array(c.pos[some] + after[some])], names)

    for batch in batches:
        null = batch.column("context").is_null()
        resolved = batch.filter(null)
        if resolved.num_rows:
            doc, pos, ahead, behind = (resolved.column(x).to_numpy().astype(np.int64) for x in ("doc_id", "pos", "ahead", "behind"))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(pos - ahead), pa.array(pos + behind)], names)
        batch = batch.filter(batch.column("context").is_valid())
        if not batch.num_rows:
            continue
        waiting.append(batch)
        count += batch.num_rows
        if count > SORTED:
            rows = pa.Table.from_batches(waiting)
            keys = rows.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
            if cut:
                yield solve(rows.slice(0, cut))
                rows = rows.slice(cut)
            waiting, count = rows.to_batches(), rows.num_rows if cut else 0
    if waiting:
        yield solve(pa.Table.from_batches(waiting))


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, places: array of (hash, pos, n)) of the anchors that stand in n > 1 places; a written table. Hashes are
    counted before they are shuffled, and the join with the counts can split a hash that stands in very many places."""
    found = docs.mapInArrow(lean(_anchor_rows), "hash long, doc_id long, pos int")
    counts = fixed(found.groupBy("hash").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1"))
    release(docs.sparkSession)
    return fixed(found.join(counts, "hash").groupBy("doc_id").agg(F.collect_list(F.struct("hash", "pos", "n")).alias("places")))  # a document's own


def later_copies(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents that equal an earlier one; a written table."""
    digests = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").alias("size"))
    # Written, so that the join below stands on two exchanges and can split a digest that very many documents share.
    firsts = fixed(digests.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return fixed(digests.join(firsts, ["digest", "size"]).where("doc_id <> first").select("doc_id"))


def shared_spans(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, spans) of what stands earlier around the repeated anchors; a written table."""
    contexts = docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(lean(_context_rows), _SHUFFLED)
    parts = shuffle_width(docs.sparkSession)
    spans = contexts.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lean(_covered_rows), "doc_id long, start long, stop long")
    return fixed(spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))


def covered(docs: DataFrame) -> DataFrame:
    """(doc_id, whole, spans): what of each document (one row an id) stands earlier; documents without it are left out.
    whole: the document equals an earlier one. spans: array of (start, stop), unsorted, overlapping. Each step is
    written, and the shuffle files behind it are released before the next one's."""
    spark = docs.sparkSession
    filled = docs.where(F.octet_length("text") >= LENGTH)
    copies = later_copies(filled)
    single = filled.join(copies, "doc_id", "left_anti")
    places = repeated_anchors(single)
    release(spark)
    spans = shared_spans(single, places)
    release(spark)
    none = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    return spans.select("doc_id", F.lit(False).alias("whole"), "spans").union(copies.select("doc_id", F.lit(True), none))


def cut_out(data: bytes, whole: bool, spans: list[dict] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is kept, and the maximal runs removed."""
    if whole:
        return (b"", [(0, len(data))]) if len(data) >= LENGTH else (data, [])
    runs: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    kept, at = [], 0
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    kept.append(data[at:])
    return b"".join(kept), [tuple(r) for r in runs]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept: the remaining bytes) of each document."""
    docs = documents(docs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for text, whole, spans in zip(texts(batch), batch.column("whole").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                kept, runs = cut_out(data, bool(whole), spans)
                rows.append((len(data), len(data) - len(kept), len(runs), kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.join(covered(docs), "doc_id", "left").mapInArrow(lean(task), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (one row an id) with ``text`` cut and n_chars, where there, counted anew. Letters of which only
    some bytes are removed go as a whole; null texts stay null."""
    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = batch.column("text").to_pylist()
            cut = [t and cut_out(t.encode(), bool(w), s)[0].decode(errors="ignore") for t, w, s in zip(given, batch.column("whole").to_pylist(), batch.column("spans").to_pylist())]
            new = {"text": pa.array(cut, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in cut]).cast(batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return docs.join(covered(docs.select("doc_id", "text")), "doc_id", "left").select(*names, "whole", "spans").mapInArrow(lean(task), docs.schema)
