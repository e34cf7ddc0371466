"""BPE of words by speculating and verifying.

A word's tokens are first proposed by greedy longest match. Its proposal is right if and only if every two neighbours are
compatible: merged alone, the two keep their border. All pairs of all new words of a batch are tested at once, with numpy:
both tokens are taken apart along the border, the later merge first, and the parts that face each other at any time must
not merge earlier than the tokens that they become part of. Only words with a pair that fails are merged exactly, in rank
order. A worker remembers the ids of words.

The tokenizer's own normaliser and splitter make words of text that is not plain; special tokens in a text are found as the
library finds them. Null and empty texts have no ids and decode to an empty text. Texts of any length are taken whole; a
task holds a few MB of them at a time. The tokenizer's file is read by the driver and sent to the tasks; its size does not
depend on the data.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from cratewise.llm.common import Numbering, documents, offsets_of, ranges, slices, texts

#: Distinct words whose ids a Python worker remembers.
REMEMBERED_WORDS = 250_000
#: Words that are proposed and tested together.
TESTED_WORDS = 50_000
_SHIFT = 20
_NEVER = np.int64(2**40)
#: Text of which words are sure to be matched alike by the tokenizer's own splitter; other text goes to that.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
_PLAIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_WORKER: dict[str, Encoder] = {}


def byte_characters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself where it is printable, else one of
    those from U+0100 on, in byte order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@dataclass
class Merges:
    """A tokenizer's merges as arrays. A symbol is a byte, or 256 more for a word's last byte; ``symbols`` are the ids of
    the 512. ``rank`` is that of the merge that makes an id (-1: a symbol), ``left`` and ``right`` are its parts.
    ``sure`` ids are what exact merging makes of their own symbols, from parts of lower rank."""

    source: str
    digest: str
    symbols: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    pair_ids: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    sure: np.ndarray
    words: list[str]
    special: dict[str, int]
    shown: list[str]

    @classmethod
    def read(cls, path: str) -> Merges:
        with open(path, encoding="utf-8") as f:
            return cls.of(f.read())

    @classmethod
    def of(cls, source: str) -> Merges:
        given = json.loads(source)
        model, special = given["model"], {t["content"]: t["id"] for t in given["added_tokens"]}
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        size = max([*vocabulary.values(), *special.values()]) + 1
        rank, left, right = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        words, shown = [""] * size, [""] * size
        symbols = np.full(512, -1, np.int64)
        for character, byte in byte_characters().items():
            for symbol, token in ((byte, character), (byte + 256, character + suffix)):
                symbols[symbol] = vocabulary[token]
                words[vocabulary[token]] = chr(symbol)
        pairs: dict[int, tuple[int, int]] = {}
        for at, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            one, two, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            pairs.setdefault(one << _SHIFT | two, (at, made))
            if not words[made]:
                rank[made], left[made], right[made], words[made] = at, one, two, words[one] + words[two]
        for token, number in [*vocabulary.items(), *special.items()]:
            shown[number] = token
        keys = np.array(sorted(pairs), np.int64)
        found = np.array([pairs[k] for k in keys.tolist()], np.int64).reshape(-1, 2)
        out = cls(source, hashlib.sha256(source.encode()).hexdigest(), symbols, keys, found[:, 0], found[:, 1], rank, left, right, np.zeros(size, bool), words, special, shown)
        ordered = (rank < 0) | ((rank[left] < rank) & (rank[right] < rank))
        table = out.pairs()
        out.sure[:] = [bool(word) and ordered[k] and out.exact(word, table) == [k] for k, word in enumerate(words)]
        return out

    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.pair_keys.tolist(), zip(self.pair_ranks.tolist(), self.pair_ids.tolist())))

    def exact(self, word: str, pairs: dict[int, tuple[int, int]]) -> list[int]:
        """The ids of a word (characters are symbols), by merging the pair of the lowest rank, leftmost first."""
        ids = self.symbols[[ord(c) for c in word]].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(pairs[key][0], k, key) for k, key in enumerate(a << _SHIFT | b for a, b in zip(ids, ids[1:])) if key in pairs]
        heapify(waiting)
        while waiting:
            _, at, key = heappop(waiting)
            gone = after[at]
            if ids[at] < 0 or gone >= n or ids[at] << _SHIFT | ids[gone] != key:
                continue
            ids[at], ids[gone] = pairs[key][1], -1
            after[at] = beyond = after[gone]
            if beyond < n:
                before[beyond] = at
            for one, two in ((before[at], at), (at, beyond)):
                if one >= 0 and two < n and (key := ids[one] << _SHIFT | ids[two]) in pairs:
                    heappush(waiting, (pairs[key][0], one, key))
        return [i for i in ids if i >= 0]

    def rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << _SHIFT | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the symbols of a and b together gives just a and b, for each pair of ids."""
        good = self.sure[a] & self.sure[b]
        open_ = np.flatnonzero(good)
        a, b = a[open_], b[open_]
        until_a = until_b = np.full(len(a), _NEVER)
        while len(open_):
            met = self.rank_of_pair(a, b)
            # A pair of the rank of its right part's next merge lies to the left of that, and goes first.
            bad = (met < until_a) & (met <= until_b) & (met < _NEVER)
            good[open_[bad]] = False
            go = ~bad & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            open_, a, b, until_a, until_b = open_[go], a[go], b[go], until_a[go], until_b[go]
            of_a = self.rank[a] >= self.rank[b]
            until_a, until_b = np.where(of_a, self.rank[a], until_a), np.where(of_a, until_b, self.rank[b])
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return good

    def spell(self) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 of each id as it is shown, with a space behind it, joined; and where each starts."""
        listed = [t.encode() + b" " for t in self.shown]
        return np.frombuffer(b"".join(listed), np.uint8), offsets_of(np.array([len(t) for t in listed], np.int64))


class Encoder:
    """Ids of texts by a worker that remembers words."""

    def __init__(self, merges: Merges) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(merges.source)
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.merges, self.pairs = merges, merges.pairs()
        self.vocabulary = {word: k for k, word in enumerate(merges.words) if merges.sure[k]}
        self.longest = max(map(len, self.vocabulary))
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        self.symbol = str.maketrans({c: chr(b) for c, b in byte_characters().items()})
        self.failed = self.proposed = 0
        self._forget()

    @classmethod
    def of_worker(cls, merges: Merges) -> Encoder:
        if merges.digest not in _WORKER:
            _WORKER.clear()
            _WORKER[merges.digest] = cls(merges)
        return _WORKER[merges.digest]

    def _forget(self) -> None:
        self.numbers = Numbering()
        self.ids, self.used, self.starts = np.zeros(1 << 16, np.int32), 0, [0]

    def propose(self, word: str) -> list[int]:
        """The ids of a word by greedy longest match."""
        at, n, out = 0, len(word), []
        while at < n:
            end = min(n, at + self.longest)
            while (token := self.vocabulary.get(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def tokens(self, words: list[str]) -> list[list[int]]:
        """The ids of each word (characters are symbols)."""
        out = [self.propose(w) for w in words]
        lengths = np.array([len(ids) for ids in out], np.int64)
        flat = np.fromiter((i for ids in out for i in ids), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.unique(owner[inside[~self.merges.compatible(flat[inside], flat[inside + 1])]])
        for k in wrong.tolist():
            out[k] = self.merges.exact(words[k], self.pairs)
        self.proposed += len(words)
        self.failed += len(wrong)
        return out

    def _learn(self, keys: list) -> None:
        for start in range(0, len(keys), TESTED_WORDS):
            part = keys[start : start + TESTED_WORDS]
            words = [k for k in part if isinstance(k, str)]
            found = iter(self.tokens(words))
            encoded = [next(found) if isinstance(k, str) else [k[0]] for k in part]
            flat = np.fromiter((i for ids in encoded for i in ids), np.int32)
            while self.used + len(flat) > len(self.ids):
                self.ids = np.append(self.ids, np.zeros_like(self.ids))
            self.ids[self.used : self.used + len(flat)] = flat
            self.starts += (self.used + np.cumsum([len(ids) for ids in encoded], dtype=np.int64)).tolist()
            self.used += len(flat)

    def words_of(self, group: str) -> list:
        """The words of a group, as symbols; a special token as (id,)."""
        if self.special is not None and "<" in group and self.special.search(group):
            parts = self.special.split(group)
            return [w for k, part in enumerate(parts) for w in ([(self.merges.special[part],)] if k % 2 else self.words_of(part))]
        if _PLAIN.fullmatch(group):
            found = [w.encode().decode("latin-1") for w in _PLAIN_WORDS.findall(group.lower())]
        else:
            found = [w.translate(self.symbol) for w, _ in self.split.pre_tokenize_str(self.normal.normalize_str(group))] if group else []
        return [w[:-1] + chr(ord(w[-1]) + 256) for w in found if w]

    def encode(self, all_texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, joined, and where each text's start."""
        groups, lists = Numbering(), []
        for text in all_texts:  # no word holds a white space, so that a group's words do not depend on its neighbours
            lists.append(list(map(groups.__getitem__, text.replace("\n", " ").split(" "))))
        if len(self.numbers) > REMEMBERED_WORDS:
            self._forget()
        known, parts, counts = len(self.numbers), [], []
        number = self.numbers.__getitem__
        for group in groups:
            words = self.words_of(group)
            parts += map(number, words)
            counts.append(len(words))
        if len(self.numbers) > known:
            self._learn(list(self.numbers)[known:])
        starts = np.array(self.starts)
        of_group = np.array(parts, np.int64)
        sizes = starts[of_group + 1] - starts[of_group]
        group_ids = self.ids[ranges(starts[of_group], sizes)]
        group_starts = offsets_of(sizes)[offsets_of(np.array(counts, np.int64))]
        flat = np.fromiter((n for numbers in lists for n in numbers), np.int64)
        lengths = np.diff(group_starts)[flat]
        ends = offsets_of(lengths)[offsets_of(np.array([len(x) for x in lists], np.int64))]
        return group_ids[ranges(group_starts[flat], lengths)], ends


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids) of each document; ids as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(Merges.read(tokenizer_path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(sent.value)
        for batch in slices(batches):
            ids, ends = encoder.encode(texts(batch))
            ids = ids.astype("<u4")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([ids[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())], ["doc_id", "ids"]
            )

    return documents(docs).mapInArrow(task, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str, keep: Sequence[Column] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, decoded): the tokens of the ids of ``encode``, special ones too, with a space between
    them; this tokenizer has no decoder that would join words."""
    sent = encoded.sparkSession.sparkContext.broadcast(Merges.read(tokenizer_path).spell())
    rows = encoded.select("doc_id", *keep, "ids")
    kept = rows.columns[:-1]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, starts = sent.value
        for batch in slices(batches, "ids", 2 << 20):
            listed = [x or b"" for x in batch.column("ids").to_pylist()]
            ids = np.frombuffer(b"".join(listed), "<u4").astype(np.int64)
            lengths = starts[ids + 1] - starts[ids]
            ends = offsets_of(lengths)[offsets_of(np.array([len(x) // 4 for x in listed], np.int64))].tolist()
            whole = letters[ranges(starts[ids], lengths)].tobytes()
            decoded = pa.array([whole[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), decoded], [*kept, "decoded"])

    schema = StructType([*rows.schema.fields[:-1], StructField("decoded", BinaryType())])
    return rows.mapInArrow(task, schema)
