"""Cross-tokenizer alignment by pointer jumping.

Both tokenizers cut a text at every single space between two other characters, so that it is a sequence of chunks, and a
chunk is encoded and aligned once per block. Inside the chunks every token points to its farthest-right overlapping token of
the other tokenizer, if that ends later; of two that end together the first tokenizer's is the terminal one. Doubling the
pointers (``at = at[at]``) until nothing changes brings every token to the terminal token of its component, its group.

A block is what a task has read until its chunks or texts pass a bound. It is written as its documents (as chunk numbers), the
links of its chunks and its distinct linked pairs of ids with their counts. Pair counts are summed over all blocks, joined
back to the blocks' pairs, and each block then sums over its documents. Only the pairs of blocks are shuffled row by row.

Null and empty texts, and texts of which either tokenizer's tokens do not spell the text after a space, have no tokens: zeros
and an empty digest. Special tokens in a text are plain text. Files are read by the driver and sent to the tasks.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import Numbering, documents, offsets_of, ranges, release, slices, texts
from cratewise.llm.wordbpe import byte_characters
from cratewise.session import fixed

#: A block ends with the slice in which it passes one of these.
BLOCK_CHUNKS, BLOCK_BYTES = 200_000, 64 << 20
#: Chunks that are encoded together.
TOGETHER = 2_000
#: A pair of ids is one number: the first's, shifted, and the second's.
SHIFT = 20
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_WORKER: dict[str, Pair] = {}


def chunks_of(text: str) -> list[str]:
    """The text between its single spaces that stand between two characters which are no white space."""
    if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or _OTHER_SPACE.search(text):
        return _CUT.split(text)
    return text.split(" ")


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For tokens of two tokenizations of the same bytes, given by their ends: the terminal token of each one's component.
    Tokens of b are numbered after those of a; a component is what overlaps lead to."""
    n = len(ends_a)
    farthest_b, farthest_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    at = np.append(np.where(ends_b[farthest_b] > ends_a, n + farthest_b, np.arange(n)) if n else ends_a, farthest_a)
    while True:
        further = at[at]
        if (further == at).all():
            return at
        at = further


class Pair:
    """Two tokenizers of a worker, and the bytes that their ids stand for."""

    def __init__(self, byte_json: str, piece_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_json)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_model)
        of_character = byte_characters()
        vocabulary = json.loads(byte_json)["model"]["vocab"]
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes_a[number] = bytes(of_character.get(c, 0) for c in token)
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.lengths_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.lengths_b = np.array([len(t) for t in self.bytes_b], np.int64)
        # A piece that holds a space behind another character would join two chunks.
        self.cuts = not any(b" " in t.lstrip(b" ") for t in self.bytes_b)

    def _piece(self, number: int) -> bytes:
        piece = self.b.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(number) else piece.replace("▁", " ").encode()

    @classmethod
    def of_worker(cls, byte_json: str, piece_model: bytes) -> Pair:
        key = hashlib.sha256(byte_json.encode() + piece_model).hexdigest()
        if key not in _WORKER:
            _WORKER.clear()
            _WORKER[key] = cls(byte_json, piece_model)
        return _WORKER[key]

    def chunks(self, text: str) -> list[str]:
        return (chunks_of(text) if self.cuts else [text]) if text else []

    def encode(self, chunk: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        one = [e.ids for e in self.a.encode_batch_fast([" " + c for c in chunk], add_special_tokens=False)]
        return one, self.b.encode(chunk, num_threads=1)


class Block:
    """The chunks that a task has met since the last block."""

    def __init__(self, pair: Pair, number: int) -> None:
        self.pair, self.number, self.size = pair, number, 0
        self.numbers = Numbering()
        self.written: list[str | None] = []  # the groups of a chunk as text, None if its tokens do not spell it
        self.counts = [np.zeros((0, 4), np.int64)]  # tokens of a, of b, groups, links
        self.links = [np.zeros(0, np.int64)]
        self.used = np.zeros(0, np.int64)

    def _learn(self, chunks: list[str]) -> None:
        one, two = self.pair.encode(chunks)
        right = []
        for c, a, b in zip(chunks, one, two):
            whole = b" " + c.encode()
            right.append(b"".join(map(self.pair.bytes_a.__getitem__, a)) == whole == b"".join(map(self.pair.bytes_b.__getitem__, b)))
        one, two = ([ids if ok else [] for ids, ok in zip(x, right)] for x in (one, two))
        n_a, n_b = (np.array([len(ids) for ids in x], np.int64) for x in (one, two))
        ids_a, ids_b = (np.fromiter((i for ids in x for i in ids), np.int64) for x in (one, two))
        ends_a, ends_b = np.cumsum(self.pair.lengths_a[ids_a]), np.cumsum(self.pair.lengths_b[ids_b])
        label = terminals(ends_a, ends_b)
        last_a, last_b = label[: len(ids_a)] == np.arange(len(ids_a)), np.append(label[len(ids_a) :][1:] != label[len(ids_a) :][:-1], len(ids_b) > 0)
        starts = ends_a - self.pair.lengths_a[ids_a]
        first = np.searchsorted(ends_b, starts, side="right")
        met = np.searchsorted(ends_b, ends_a) - first + 1
        self.links.append(np.repeat(ids_a, met) << SHIFT | ids_b[ranges(first, met)])
        of_a = np.repeat(np.arange(len(chunks)), n_a)
        groups, links = (np.bincount(of_a, w, len(chunks)).astype(np.int64) for w in (last_a, met))
        self.counts.append(np.stack([n_a, n_b, groups, links], 1))
        self.written += _written(ids_a.tolist(), last_a.tolist(), n_a.tolist(), ids_b.tolist(), last_b.tolist(), right)

    def rows(self, doc_ids: list[int], all_texts: list[str]) -> Iterator[tuple]:
        """A row of each document."""
        known = len(self.numbers)
        lists = [list(map(self.numbers.__getitem__, self.pair.chunks(t))) for t in all_texts]
        new = list(self.numbers)[known:]
        for at in range(0, len(new), TOGETHER):
            self._learn(new[at : at + TOGETHER])
        counts = np.concatenate(self.counts)
        self.counts = [counts]
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        pack = zstandard.ZstdCompressor().compress
        for doc_id, text, numbers in zip(doc_ids, all_texts, lists):
            self.size += len(text)
            parts = list(map(self.written.__getitem__, numbers))
            if None in parts:
                numbers, parts = [], []
            mine = np.array(numbers, np.int64)
            self.used += np.bincount(mine, minlength=len(self.used)) if len(mine) > 10_000 else 0
            if len(mine) <= 10_000:
                np.add.at(self.used, mine, 1)
            n_a, n_b, groups, links = counts[mine].sum(0).tolist()
            yield doc_id, n_a, n_b, groups, links, hashlib.sha256(";".join(parts).encode()).hexdigest() if parts else "", pack(mine.astype("<u4").tobytes())

    def structure(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Of all chunks, the places of their links in the sorted distinct pairs; those pairs; and the links that hold each."""
        links, sizes = np.concatenate(self.links), np.concatenate(self.counts)[:, 3]
        keys, at = np.unique(links, return_inverse=True)
        n = np.bincount(at, np.repeat(self.used, sizes), len(keys)).astype(np.int64)
        return zstandard.ZstdCompressor().compress(np.concatenate([[len(sizes)], sizes, at]).astype("<u4").tobytes()), keys, n


def _written(ids_a: list[int], last_a: list[bool], n_a: list[int], ids_b: list[int], last_b: list[bool], right: list[bool]) -> Iterator[str | None]:
    """The groups of each chunk as ``a1,a2|b1;a3|b2``."""
    at = to = 0
    for n, ok in zip(n_a, right):
        groups, a, end = [], [], at + n
        while at < end:
            a.append(str(ids_a[at]))
            if last_a[at]:
                b = [str(ids_b[to])]
                while not last_b[to]:
                    to += 1
                    b.append(str(ids_b[to]))
                to += 1
                groups.append(",".join(a) + "|" + ",".join(b))
                a = []
            at += 1
        yield ";".join(groups) if ok else None


_DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, chunks binary"
_BLOCK = "block long, " + _DOCUMENT + ", structure binary, keys array<long>, counts array<long>"
_NAMES = [c.split(" ")[0] for c in _BLOCK.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def blocks(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """The documents and, in rows without a doc_id, the structures of the tasks' blocks."""
    with open(byte_json, encoding="utf-8") as f, open(piece_model, "rb") as g:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair.of_worker(*sent.value)
        number = TaskContext.get().partitionId() << 32
        block = Block(pair, number)

        def finished() -> pa.RecordBatch:
            structure, keys, n = block.structure()
            return _batch([(block.number, *[None] * 7, structure, keys, n)])

        for batch in slices(batches):
            rows = block.rows(batch.column("doc_id").to_pylist(), texts(batch))
            yield _batch([(block.number, *row, None, None, None) for row in rows])
            if len(block.numbers) > BLOCK_CHUNKS or block.size > BLOCK_BYTES:
                yield finished()
                number += 1
                block = Block(pair, number)
        if block.size:
            yield finished()

    return documents(docs).mapInArrow(task, _BLOCK)


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a block with sums over their links; ``right``: the block's pairs with their count in all blocks and
    whether it is the highest of their second id."""
    listed = [s for s in left.column("structure").to_pylist() if s is not None]
    order = np.argsort(right.column("key").to_numpy())
    count, best = right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
    unpack = zstandard.ZstdDecompressor().decompress
    rows = left.filter(left.column("doc_id").is_valid())
    numbers = [np.frombuffer(unpack(c), "<u4") for c in rows.column("chunks").to_pylist()]
    sums = np.zeros((len(numbers), 2), np.int64)
    if listed:
        flat = np.frombuffer(unpack(listed[0]), "<u4").astype(np.int64)
        sizes, at = flat[1 : 1 + flat[0]], flat[1 + flat[0] :]
        bounds = offsets_of(sizes)
        of_chunk = np.stack([np.diff(offsets_of(x[at])[bounds]) for x in (best, count)], 1)
        for k, mine in enumerate(numbers):
            sums[k] = of_chunk[mine].sum(0)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    columns = [*(rows.column(c) for c in names), pa.array(sums[:, 0]), pa.array(sums[:, 1]), rows.column("groups_sha256")]
    return pa.table(columns, [*names, "n_best", "count_sum", "groups_sha256"])


def align(docs: DataFrame, byte_json: str, piece_model: str) -> DataFrame:
    """One row a document: n_a, n_b tokens, n_groups, n_links, n_best (links whose pair count is the highest of their second
    id), count_sum (of the pair counts of its links), groups_sha256 (of its groups of ids)."""
    held = fixed(blocks(docs, byte_json, piece_model))
    release(docs.sparkSession)
    mine = held.where("doc_id IS NULL").select("block", F.explode(F.arrays_zip("keys", "counts")).alias("p")).select("block", F.col("p.keys").alias("key"), F.col("p.counts").alias("n"))
    total = fixed(mine.groupBy("key").agg(F.sum("n").alias("count")).withColumn("second", F.col("key") % (1 << SHIFT)))
    release(docs.sparkSession)
    highest = total.groupBy("second").agg(F.max("count").alias("most"))  # one row an id of the second vocabulary
    valued = total.join(highest, "second").select("key", "count", (F.col("count") == F.col("most")).cast("long").alias("best"))
    of_block = mine.select("block", "key").join(valued, "key").select(F.col("block").alias("at"), "key", "count", "best")
    sums = held.groupBy("block").cogroup(of_block.groupBy("at"))
    return sums.applyInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
