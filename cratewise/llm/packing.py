"""Packing of documents into sequences by best-two-fit.

Documents become pieces of at most one sequence each; pieces of one length are interchangeable, so the packing is
planned on the histogram of lengths, which never has more entries than a sequence has tokens. A bin is filled greedily,
the longest piece that fits first; then its smallest piece is replaced by two unpacked ones if they fill its expanded
gap more tightly. A bin's recipe is used as often as the histogram allows. Pieces then take the places of their length
by their rank, counted within salted parts of a length.

Null and empty texts are one piece that holds the end id alone. Ties of length go by doc_id and piece. A tokenizer
file is read by the driver and sent to the tasks; its size does not depend on the data.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import batched, chain, compress, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cratewise.llm.common import Numbering, documents, give_back, lean, offsets_of, ranges, remembered, slices, texts
from cratewise.session import fixed

#: Distinct words whose ids a Python worker remembers.
REMEMBERED_WORDS = 400_000
#: Groups whose ids it remembers from slice to slice, and letters that its groups, and its words, may have; one slice more at most.
REMEMBERED_GROUPS = 400_000
REMEMBERED_LETTERS = 16_000_000
#: Plain words that the tokenizer gets in one string.
WORDS_AT_ONCE = 1_024
#: Pieces in a salted part, on average.
PART_PIECES = 200_000
#: Text of which words are sure to be matched alike by the tokenizer's own pattern; other text goes to it unsplit.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Words that the tokenizer gets at a time: what it returns for a word takes many times the word's own room.
TOKENIZED_WORDS = 16_384
#: Slices after which a worker gives freed memory back.
SLICES = 4


class Words:
    """Ids of space-separated groups by the tokenizer. It splits at white space, so that a group's ids do not depend on
    its neighbours; the words of a group likewise, where the group is plain text."""

    def __init__(self, tokenizer_json: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        suffix = json.loads(tokenizer_json)["model"].get("end_of_word_suffix")
        self.ends_word = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._forget()
        self.groups, self.letters, self.recent = Numbering(), 0, np.zeros(0, np.int64)
        self.group_ids, self.group_starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    @classmethod
    def of_worker(cls, tokenizer_json: str) -> Words:
        return remembered(f"packing {hashlib.sha256(tokenizer_json.encode()).hexdigest()}", lambda: cls(tokenizer_json))

    def _forget(self) -> None:
        self.numbers, self.word_letters = Numbering(), 0
        self.ids, self.used, self.starts = np.zeros(1 << 16, np.int32), 0, np.zeros(1, np.int64)

    def _keep_recent(self) -> None:
        """Only the groups of the last slice stay: frequent ones are among them."""
        names, recent = list(self.groups), np.unique(self.recent)
        sizes = self.group_starts[recent + 1] - self.group_starts[recent]
        self.group_ids = self.group_ids[ranges(self.group_starts[recent], sizes)]
        self.group_starts, self.groups = offsets_of(sizes), Numbering()
        for n in recent.tolist():
            self.groups[names[n]]
        self.recent, self.letters = np.arange(len(recent)), sum(map(len, self.groups))

    def _learn(self, words: list[str]) -> None:
        flat, sizes = (np.concatenate(x) for x in zip(*(self._tokenized(list(part)) for part in batched(words, TOKENIZED_WORDS))))
        self.word_letters += sum(map(len, words))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.append(self.ids, np.zeros_like(self.ids))
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts = np.append(self.starts, self.used + np.cumsum(sizes))
        self.used += len(flat)

    def _tokenized(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, joined, and how many each has. Plain words go to the tokenizer many at a time, with a space between them,
        and the ids that end a word tell them apart."""
        if self.ends_word is None:
            return self._one_by_one(words)
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        listed = list(compress(words, plain))
        lines = [listed[at : at + WORDS_AT_ONCE] for at in range(0, len(listed), WORDS_AT_ONCE)]
        parts = [self._one_by_one(list(compress(words, ~plain)))]
        for line, encoded in zip(lines, self.tokenizer.encode_batch_fast([" ".join(line) for line in lines], add_special_tokens=False)):
            ids = np.array(encoded.ids, np.int32)
            ends = np.flatnonzero(self.ends_word[ids])
            known = len(ends) == len(line) and ends[-1] == len(ids) - 1
            parts.append((ids, np.diff(ends, prepend=-1)) if known else self._one_by_one(line))
        flat, sizes = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(np.argsort(plain, kind="stable"))  # where each word went
        return flat[ranges(offsets_of(sizes)[order], sizes[order])], sizes[order]

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), np.int32), np.array([len(ids) for ids in encoded], np.int64)

    def _learn_groups(self, groups: list[str]) -> None:
        if len(self.numbers) > REMEMBERED_WORDS or self.word_letters > REMEMBERED_LETTERS:
            self._forget()
        known, parts, counts = len(self.numbers), [], []
        number = self.numbers.__getitem__
        for group in groups:
            if _PLAIN.fullmatch(group):
                words = _PLAIN_WORDS.findall(group.lower())
            else:
                words = [group] if group else []
            parts += map(number, words)
            counts.append(len(words))
        if len(self.numbers) > known:
            self._learn(list(islice(self.numbers, known, None)))
        parts_a = np.array(parts, np.int64)
        starts = self.starts[parts_a]
        sizes = self.starts[parts_a + 1] - starts
        ends = offsets_of(sizes)[offsets_of(np.array(counts, np.int64))]
        self.group_starts = np.append(self.group_starts, self.group_starts[-1] + ends[1:])
        self.group_ids = np.append(self.group_ids, self.ids[ranges(starts, sizes)])
        self.letters += sum(map(len, groups))

    def encode(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, joined, and where each text's start."""
        if len(self.groups) > REMEMBERED_GROUPS or self.letters > REMEMBERED_LETTERS:
            self._keep_recent()
        known = len(self.groups)
        counts = np.array([text.count(" ") + text.count("\n") + 1 for text in all_texts], np.int64)
        groups = chain.from_iterable(text.replace("\n", " ").split(" ") for text in all_texts)
        flat = np.fromiter(map(self.groups.__getitem__, groups), np.int64, int(counts.sum()))
        if len(self.groups) > known:
            self._learn_groups(list(islice(self.groups, known, None)))
        self.recent = flat
        starts = self.group_starts[flat]
        lengths = self.group_starts[flat + 1] - starts
        return self.group_ids[ranges(starts, lengths)], offsets_of(lengths)[offsets_of(counts)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """(doc_id, piece from 0, start, length, ids as little-endian unsigned 32-bit integers): each document's ids and
    ``end_id``, cut every ``capacity`` ids."""
    with open(tokenizer_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words.of_worker(sent.value)
        for n, batch in enumerate(slices(batches), 1):
            if not n % SLICES:
                give_back()
            ids, ends = words.encode(texts(batch))
            rows: list[tuple] = []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[ends[k] : ends[k + 1]], end_id).astype("<u4")
                for start in range(0, len(own), capacity):
                    cut = own[start : start + capacity]
                    rows.append((doc_id, start // capacity, start, len(cut), cut.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE_TYPES)], ["doc_id", "piece", "start", "length", "ids"])

    return documents(docs).mapInArrow(task, "doc_id long, piece int, start long, length long, ids binary")


_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]


def recipes(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a bin, how many such bins): all pieces of the histogram, best-two-fit."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        there = np.flatnonzero(left).tolist()
        used: Counter[int] = Counter()
        gap = capacity
        at = len(there) - 1
        while at >= 0:  # longest first
            length = there[at]
            fit = min(gap // length, int(left[length]))
            if fit:
                used[length] += fit
                gap -= fit * length
            at = min(at, bisect_right(there, gap)) - 1
        if gap:
            smallest = min(used)
            pair = _best_two(left, used, gap + smallest)
            if sum(pair) > smallest:
                used.subtract([smallest])
                used.update(pair)
                used = +used
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= n * times
        out.append((tuple(sorted(used.elements(), reverse=True)), times))
    return out


def _best_two(left: np.ndarray, used: Counter[int], room: int) -> tuple[int, ...]:
    """Two unpacked lengths with the largest sum that fits; none if no two fit."""
    free = left[: room + 1].copy()
    for length, n in used.items():
        if length <= room:
            free[length] -= n
    lengths = np.flatnonzero(free)
    if not len(lengths):
        return ()
    at = np.searchsorted(lengths, np.minimum(room - lengths, lengths), side="right") - 1
    twin = (at >= 0) & (lengths[at] == lengths) & (free[lengths] < 2)  # its own twin, of which there is one alone
    at = at - twin
    sums = np.where(at >= 0, lengths + lengths[np.maximum(at, 0)], 0)
    best = int(sums.argmax())
    return (int(lengths[best]), int(lengths[at[best]])) if sums[best] else ()


def pack(cut: DataFrame, capacity: int = 2048) -> DataFrame:
    """The rows of ``cut`` (doc_id, piece, length and others; read more than once, so a written table) with sequence_id
    and offset: at most ``capacity`` tokens a sequence, no gaps."""
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length: capacity rows at most
    taken: Counter[int] = Counter()
    slots: dict[int, list[tuple[int, int, int]]] = {length: [] for length in counts}  # first rank, sequence of it, offset
    sequence = 0
    for lengths, times in recipes(counts, capacity):
        offset = 0
        for length in lengths:
            slots[length].append((taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    places = cut.sparkSession.sparkContext.broadcast({length: np.array(s, np.int64).reshape(-1, 3) for length, s in slots.items()})

    parts = max(8, sum(counts.values()) // PART_PIECES)
    salted = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)))
    sizes = salted.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = sizes.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(earlier, ["length", "_part"]).select(*cut.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            where = np.zeros((len(rank), 2), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                table = places.value[length]
                slot = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                where[mine, 0] = slot[:, 1] + rank[mine] - slot[:, 0]
                where[mine, 1] = slot[:, 2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(where[:, 0]), pa.array(where[:, 1])], [*names, "sequence_id", "offset"])

    names = cut.columns
    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(lean(task), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """The pieces of all documents in their places; of a piece's ids, their CRC-32."""
    cut = fixed(pieces(docs, tokenizer_path, capacity).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(cut, capacity)
