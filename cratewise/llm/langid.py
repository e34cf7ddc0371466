"""Language identification of mixed-language text: script ranges, per-word scores, Viterbi.

A language's model is the smoothed log-probability of hashed letter n-grams (1 to 4 letters, with word borders) and
the scripts its training letters lie in. A word's script leaves the languages that use it as candidates; the word's
score for each is the sum over its n-grams. Viterbi over a document's words, with a penalty for each switch, gives
spans of one language. The document's language is the one with most letters, its score that language's share.

Fitting reads about ``SAMPLE_DOCS`` labelled documents of each language, chosen by a hash of their id, and whole
texts; null labels and null texts teach nothing. Prediction takes every text whole; null texts, texts without letters
and (if nothing was learned) all texts are ``und`` with score 0. Equal totals go to the first language by name. Words
in a script that no learned language uses are evidence for none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import Numbering, documents, lean, offsets_of, slices, texts

#: Labelled documents of a language that are learned from, on average at most.
SAMPLE_DOCS = 1_500
BUCKETS = 1 << 16
LONGEST_GRAM = 4
SMOOTHING = 0.5
#: Cost of a switch of language between two words, in nats.
SWITCH = 8.0
#: A word speaks for one language over another by this many nats at most.
MOST_EVIDENCE = 12.0
#: Share of a language's training letters from which it counts as using a script.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
#: Padded words that Viterbi holds at a time.
_CELLS = 500_000

# First code point of each Unicode script range, and the script.
SCRIPT_RANGES = [
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"),
    (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_RANGE_STARTS = np.array([a for a, _ in SCRIPT_RANGES])
_RANGE_SCRIPTS = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES])


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of the words: the number of the word that each belongs to, and its bucket."""
    points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    border = points == 0
    word = np.cumsum(border) - 1
    owners, buckets = [], []
    h = np.zeros(len(points), np.uint64)
    inner = np.zeros(len(points), bool)  # a border strictly inside the n-gram
    for n in range(1, LONGEST_GRAM + 1):
        size = len(points) - n + 1
        if size <= 0:
            break
        if n > 2:
            inner = inner[:size] | border[n - 2 : n - 2 + size]
        h = (h[:size] * np.uint64(0x100000001B3) + points[n - 1 : n - 1 + size] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        ok = ~border if n == 1 else ~inner[:size]
        if n == 2:
            ok = ~(border[:-1] & border[1:])
        ok = np.flatnonzero(ok)
        owners.append(word[ok])
        buckets.append(((h[ok] >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    real = owner < len(words)
    return owner[real], bucket[real]


def scripts_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    return _RANGE_SCRIPTS[np.maximum(np.searchsorted(_RANGE_STARTS, first, side="right") - 1, 0)]


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # BUCKETS x languages
    uses: np.ndarray  # scripts x languages
    log_prior: np.ndarray  # languages; where a text starts

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, bucket = grams(words)
        out = np.stack([np.bincount(owner, weights=self.log_prob[bucket, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)
        may = self.uses[scripts_of(words)]
        out = np.where(may, np.maximum(out - np.where(may, out, -np.inf).max(axis=1, keepdims=True, initial=-1e9), -MOST_EVIDENCE), -MOST_EVIDENCE)
        out[~may.any(axis=1)] = 0
        return out.astype(np.float32)

    def spans(self, all_texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Of each text: (first word, words, letters, language number) of each span."""
        words = Numbering()
        lists = [np.array(list(map(words.__getitem__, words_of(t))), np.int64) for t in all_texts]
        if not words or not self.languages:
            return [[] for _ in all_texts]
        names = list(words)
        letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in names])
        scores = np.vstack([self.word_scores(names), np.zeros((1, len(self.languages)), np.float32)])  # the last: no word
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in all_texts]
        for group in _alike([len(x) for x in lists]):
            length = len(lists[group[-1]])
            table = np.full((length, len(group)), len(names), np.int64)
            for k, g in enumerate(group):
                table[: len(lists[g]), k] = lists[g]
            path = viterbi(scores, table, self.log_prior)
            for k, g in enumerate(group):
                own, states = lists[g], path[: len(lists[g]), k]
                starts = np.append(0, np.flatnonzero(np.diff(states)) + 1)
                n = np.add.reduceat(letters[own], starts)
                out[g] = list(zip(starts.tolist(), np.diff(np.append(starts, len(own))).tolist(), n.tolist(), states[starts].tolist()))
        return out

    def predict(self, all_texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, int, int]]]]:
        out = []
        for spans in self.spans(all_texts):
            totals = np.bincount([s[3] for s in spans], weights=[s[2] for s in spans], minlength=1) if spans else np.zeros(1)
            whole = totals.sum()
            best = int(totals.argmax())
            out.append((self.languages[best], float(totals[best] / whole), spans) if whole else (UNKNOWN, 0.0, []))
        return out


def _alike(lengths: list[int]) -> Iterator[list[int]]:
    """Places of the texts that have words, shortest first, in groups of about _CELLS padded words."""
    group: list[int] = []
    for k in sorted((k for k, n in enumerate(lengths) if n), key=lengths.__getitem__):
        if group and (len(group) + 1) * lengths[k] > _CELLS:
            yield group
            group = []
        group.append(k)
    if group:
        yield group


def viterbi(scores: np.ndarray, table: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best languages (words x texts) for word numbers ``table`` (words x texts)."""
    n, width = table.shape
    rows = np.arange(width)
    value = scores[table[0]] + start
    came_best = np.zeros((n, width), np.uint8 if scores.shape[1] < 256 else np.int32)
    switched = np.zeros((n, width, scores.shape[1]), bool)
    for t in range(1, n):
        best = value.argmax(axis=1)
        bar = value[rows, best][:, None] - SWITCH
        came_best[t] = best
        np.less(value, bar, out=switched[t])
        value = np.maximum(value, bar) + scores[table[t]]
    path = np.zeros((n, width), np.int64)
    state = value.argmax(axis=1)
    for t in range(n - 1, -1, -1):
        path[t] = state
        state = np.where(switched[t, rows, state], came_best[t], state)
    return path


def fit(labelled: DataFrame) -> Model:
    """``labelled``: doc_id, text, lang."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().collect()  # one row a label
    languages = sorted(r.lang for r in sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool), np.zeros(0))
    bar = F.least(F.lit(1_000_000), F.floor(F.lit(SAMPLE_DOCS * 1_000_000) / F.col("count")))
    sample = rows.join(rows.groupBy("lang").count(), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < bar).select("doc_id", "text", "lang")
    place = {name: k for k, name in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)), np.int64)
        for batch in slices(batches):
            by: dict[int, list[str]] = {}
            for text, lang in zip(texts(batch), batch.column("lang").to_pylist()):
                by.setdefault(place[lang], []).extend(words_of(text))
            for k, words in by.items():
                if words:
                    counts[:BUCKETS, k] += np.bincount(grams(words)[1], minlength=BUCKETS)
                    counts[BUCKETS:, k] += np.bincount(scripts_of(words), weights=[len(w) for w in words], minlength=len(SCRIPTS)).astype(np.int64)
        at, lang = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(lang), pa.array(counts[at, lang])], ["at", "lang", "n"])

    summed = sample.mapInArrow(lean(task), "at long, lang long, n long").groupBy("at", "lang").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows a language at most
    counts = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    counts[summed.column("at").to_numpy(), summed.column("lang").to_numpy()] = summed.column("n").to_numpy()
    smooth = counts[:BUCKETS] + SMOOTHING
    shares = counts[BUCKETS:] / np.maximum(counts[BUCKETS:].sum(axis=0), 1)
    frequency = {r.lang: r["count"] for r in sizes}
    prior = np.array([frequency[name] for name in languages], float)
    return Model(languages, np.log(smooth / smooth.sum(axis=0)), shares >= SCRIPT_SHARE, np.log(prior / prior.sum()).astype(np.float32))


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("letters", pa.int32()), ("lang", pa.string())]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, spans) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores, spans = zip(*sent.value.predict(texts(batch)))
            names = sent.value.languages
            listed = [[(a, b, c, names[k]) for a, b, c, k in s] for s in spans]
            flat = [x for s in listed for x in s]
            columns = [pa.array([x[c] for x in flat], _SPANS.value_type[c].type) for c in range(4)]
            nested = pa.ListArray.from_arrays(pa.array(offsets_of(np.array([len(s) for s in listed])), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_SPANS.value_type)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs), pa.array(scores), nested], ["doc_id", "lang_pred", "score", "spans"])

    return documents(docs).mapInArrow(task, "doc_id long, lang_pred string, score double, spans array<struct<first_word:int, words:int, letters:int, lang:string>>")
