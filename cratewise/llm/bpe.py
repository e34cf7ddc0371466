"""Byte-level BPE by corpus-level merge replay.

The documents of a task are one corpus. Its distinct pre-tokens are laid out as one linked list of byte tokens; an
inverted index from merge rank to positions is replayed in rank order, each merge applied at all its positions at
once and only the neighbours of those positions looked up anew. Documents are then written as their pre-tokens' ids.

Null and empty texts have no ids and decode to no bytes. Texts of any length are taken whole. A rank file is read by
the driver and sent to the tasks; its size does not depend on the data.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from cratewise.llm.common import Numbering, documents, offsets_of, ranges, slices, texts

#: Distinct pre-token groups that a task replays together; more come in a further replay.
REPLAY_GROUPS = 150_000
#: Bytes of text that a task replays together, and ids that it returns in one batch.
CORPUS_BYTES, OUT_IDS = 10 << 20, 500_000
_SHIFT = 20
_NONE = np.int32(2**31 - 1)
#: White space other than the plain space and the line feed.
_OTHER_SPACE = regex.compile(r"[^\S \n]")
#: A plain space that is not alone between two characters that are no white space.
_ODD_SPACE = regex.compile(r"\A | \s|\s | \Z")


@dataclass
class Ranks:
    """A rank file: the id of each single byte, and of each pair of ids that may merge."""

    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    byte_offsets: np.ndarray
    byte_values: np.ndarray

    @classmethod
    def read(cls, path: str) -> Ranks:
        with open(path, "rb") as f:
            return cls.of({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)})

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Ranks:
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = rank
        keys = np.array(sorted(pairs), np.int64)
        spelled = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            spelled[rank] = token
        return cls(
            np.array([ranks[bytes([b])] for b in range(256)], np.int32), keys, np.array([pairs[k] for k in keys.tolist()], np.int32),
            offsets_of(np.array([len(t) for t in spelled])), np.frombuffer(b"".join(spelled), np.uint8),
        )

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, _NONE if none. A negative id merges with nothing."""
        keys = left.astype(np.int64) << _SHIFT | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (left >= 0) & (right >= 0), self.pair_ids[at], _NONE)

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, joined, and the number of bytes of each."""
        lengths = self.byte_offsets[ids + 1] - self.byte_offsets[ids]
        return self.byte_values[ranges(self.byte_offsets[ids], lengths)], lengths


def _apart(positions: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping pairs (x x x) the leftmost, then every second."""
    taken, keep = -1, []
    for p, nxt in zip(positions.tolist(), after.tolist()):
        if p != taken:
            keep.append(p)
            taken = nxt
    return np.array(keep, np.int64)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words (none of them empty), joined, and the number of ids of each word."""
    lengths = np.array([len(w) for w in words], np.int64)
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    starts = np.cumsum(lengths) - lengths
    token = np.append(ranks.byte_ids[np.frombuffer(b"".join(words), np.uint8)], np.int32(-1))  # the last place is nowhere
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[starts + lengths - 1] = n
    after[n] = n
    before[starts] = n
    alive = np.ones(n + 1, bool)
    alive[n] = False
    rank = ranks.merged(token, token[after])
    index: dict[int, list[int]] = {}  # rank -> positions of the left part

    def note(positions: np.ndarray, found: np.ndarray) -> None:
        real = found != _NONE
        positions, found = positions[real], found[real]
        if len(found) > 64:
            order = np.argsort(found, kind="stable")
            positions, found = positions[order], found[order]
            cuts = np.append(np.flatnonzero(np.diff(found)) + 1, len(found)).tolist()
            start = 0
            listed = positions.tolist()
            for end in cuts:
                r = int(found[start])
                if r in index:
                    index[r] += listed[start:end]
                else:
                    index[r] = listed[start:end]
                    heapq.heappush(waiting, r)
                start = end
            return
        for p, r in zip(positions.tolist(), found.tolist()):
            if r in index:
                index[r].append(p)
            else:
                index[r] = [p]
                heapq.heappush(waiting, r)

    waiting: list[int] = []
    note(np.arange(n + 1), rank)
    while waiting:
        r = heapq.heappop(waiting)
        at = np.array(index.pop(r), np.int64)
        at = at[rank[at] == r]  # not those that an earlier merge has changed
        if len(at) > 1:
            at.sort()
            at = at[np.append(True, at[1:] != at[:-1])]
            if (after[at[:-1]] == at[1:]).any():
                at = _apart(at, after[at])
        if not len(at):
            continue
        gone = after[at]
        beyond = after[gone]
        token[at] = r
        alive[gone] = False
        rank[gone] = _NONE
        after[at] = beyond
        before[beyond] = at
        left = before[at]
        for p in (at, left):
            rank[p] = ranks.merged(token[p], token[after[p]])
        rank[n] = _NONE
        touched = np.concatenate((at, left))
        note(touched, rank[touched])
    return token[alive], np.add.reduceat(alive, starts, dtype=np.int64)


class Groups:
    """Space-separated groups of a text, each encoded once. A group is the text from one plain space that stands alone
    up to before the next: the pattern always starts a match there. Texts with any other arrangement of spaces are
    split by the pattern as a whole, each match a group."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.numbers = regex.compile(pattern), Numbering()

    def of(self, text: str) -> list[int]:
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text) and _ODD_SPACE.search(text):
            return [self.numbers[m, 1] for m in self.pattern.findall(text)]
        first, *rest = text.split(" ")
        return [self.numbers[first, 0], *map(self.numbers.__getitem__, rest)]

    def encode(self, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all groups in number order, joined, and where each group's start."""
        words, parts, counts = Numbering(), [], []
        find, number = self.pattern.findall, words.__getitem__
        for key in self.numbers:
            if isinstance(key, str):
                matches = find(" " + key)
            else:
                matches = [key[0]] if key[1] else find(key[0])
            parts += map(number, matches)
            counts.append(len(matches))
        ids, lengths = replay([w.encode() for w in words], ranks)
        starts = offsets_of(lengths)
        parts_a, bounds = np.array(parts, np.int64), offsets_of(np.array(counts, np.int64))
        sizes = offsets_of(lengths[parts_a])
        return ids[ranges(starts[parts_a], lengths[parts_a])], sizes[bounds]


def encode_texts(all_texts: list[str], pattern: str, ranks: Ranks) -> Iterator[np.ndarray]:
    """The ids of each text, in order."""
    at = 0
    while at < len(all_texts):
        groups, taken = Groups(pattern), []
        while at < len(all_texts) and len(groups.numbers) < REPLAY_GROUPS:
            taken.append(np.array(groups.of(all_texts[at]), np.int64))
            at += 1
        ids, starts = groups.encode(ranks)
        lengths = np.diff(starts)
        for numbers in taken:
            yield ids[ranges(starts[numbers], lengths[numbers])]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each document; ids as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(Ranks.read(ranks_path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, corpus in corpora(batches):
            out, held = [], 0
            for doc_id, ids in zip(doc_ids, encode_texts(corpus, pattern, sent.value)):
                out.append((doc_id, ids.astype("<u4").tobytes()))
                held += len(ids)
                if held > OUT_IDS:
                    yield _rows(out)
                    out, held = [], 0
            yield _rows(out)

    return documents(docs).mapInArrow(task, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, keep: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, decoded): the bytes that the ids of ``encode`` stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(Ranks.read(ranks_path))
    rows = encoded.select("doc_id", *keep, "ids")
    kept = rows.columns[:-1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids", 2 << 20):
            listed = [x or b"" for x in batch.column("ids").to_pylist()]
            spelled, lengths = sent.value.spell(np.frombuffer(b"".join(listed), "<u4").astype(np.int64))
            ends = offsets_of(lengths)[offsets_of(np.array([len(x) // 4 for x in listed]))].tolist()
            whole = spelled.tobytes()
            decoded = pa.array([whole[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded], [*kept, "decoded"])

    schema = StructType([*rows.schema.fields[:-1], StructField("decoded", BinaryType())])
    return rows.mapInArrow(task, schema)


def corpora(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Document ids and texts of the task, about CORPUS_BYTES at a time."""
    ids, held, size = [], [], 0
    for batch in slices(batches, size=CORPUS_BYTES):
        ids += batch.column("doc_id").to_pylist()
        held += texts(batch)
        size += batch.nbytes
        if size > CORPUS_BYTES:
            yield ids, held
            ids, held, size = [], [], 0
    if ids:
        yield ids, held


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ids"])
