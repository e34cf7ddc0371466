"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j). The pairs are scored in linear time:
their sum is half of (sum v_i x_i)^2 - sum v_i^2 x_i^2, over the factors.

Features of a text: its hashed words (binary, scaled to unit length), statistics of its characters, words and lines
as clipped numbers and as bins, and one constant. Fitting reads about ``SAMPLE_DOCS`` labelled documents, chosen by a
hash of their id, whole texts. Labels, language, source and id are no inputs. Null texts count as empty, and empty
texts get a score like any other. Repeated labels of a document count once, the smallest; null labels not at all.
Without labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.llm.common import Numbering, documents, lean, offsets_of, ranges, slices, texts

SAMPLE_DOCS = 6_000
WORD_BUCKETS = 1 << 14
BINS = 10
FACTORS = 6
#: Few labels are gone over until LEAST_STEPS are done.
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 12, 500, 128, 0.03, 2e-5
#: Score from which a text counts as good.
GOOD = 0.3

_CLASSES = ["upper", "lower", "digit", "space", "line", "point", "mark", "high"]
_CLASS_OF = np.array([
    0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 4 if b == 10 else 3 if b in (32, 9, 11, 12, 13) else 5 if chr(b) in ".,;:'\"()-?" else 7 if b >= 128 else 6
    for b in range(256)
])
STATISTICS = 16
FIRST_BIN = WORD_BUCKETS + STATISTICS
FEATURES = FIRST_BIN + STATISTICS * BINS


def features(all_texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, starts) of the texts' hashed words, sparse, and their statistics (texts x STATISTICS)."""
    n = len(all_texts)
    raw = [t.encode() for t in all_texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * 8 + _CLASS_OF[np.frombuffer(b"".join(raw), np.uint8)], minlength=8 * n).reshape(n, 8).astype(float)
    numbers = Numbering()
    lists = [list(map(numbers.__getitem__, t.split())) for t in all_texts]
    names = list(numbers)
    count = np.array([len(x) for x in lists], np.int64)
    flat = np.array([w for x in lists for w in x], np.int64)
    bucket = np.array([zlib.crc32(w.lower().encode()) % WORD_BUCKETS for w in names], np.int64)
    traits = np.array([(len(w), w.isupper() and len(w) > 1, not w[-1].isalnum() and w[-1] not in ".,;:?)'\"", w.isalpha() and w.islower()) for w in names], float).reshape(-1, 4)
    text_of = np.repeat(np.arange(n), count)
    means = np.stack([np.bincount(text_of, weights=traits[flat, k], minlength=n) for k in range(4)], axis=1) / np.maximum(count, 1)[:, None]
    pairs = np.unique(text_of * len(names) + flat) // max(len(names), 1)
    distinct = np.bincount(pairs, minlength=n)
    lines = [[x for x in t.split("\n") if x] for t in all_texts]
    line_count = np.array([max(len(x), 1) for x in lines], float)
    repeated = np.array([1 - len(set(x)) / len(x) if x else 0 for x in lines])
    size = np.maximum(sizes, 1)
    letters = np.maximum(kinds[:, 0] + kinds[:, 1] + kinds[:, 7], 1)
    stats = np.column_stack([
        np.log1p(sizes), np.log1p(count), kinds[:, 0] / letters, kinds[:, 2] / size, (kinds[:, 3] + kinds[:, 4]) / size, kinds[:, 5] / size, kinds[:, 6] / size, kinds[:, 7] / size,
        means[:, 0], means[:, 1], means[:, 2], means[:, 3], distinct / np.maximum(count, 1), np.log1p(line_count), np.log1p(sizes / np.maximum(line_count, 1)), repeated,
    ])
    hashed = np.unique(text_of * WORD_BUCKETS + bucket[flat]) if len(flat) else np.zeros(0, np.int64)
    per_text = np.bincount(hashed // WORD_BUCKETS, minlength=n)
    return hashed % WORD_BUCKETS, np.repeat(1 / np.sqrt(np.maximum(per_text, 1)), per_text), offsets_of(per_text), stats


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # FEATURES
    factor: np.ndarray  # FEATURES x FACTORS
    centre: np.ndarray
    spread: np.ndarray
    edges: np.ndarray  # STATISTICS x (BINS - 1)

    def dense(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of the statistics' features, 2 * STATISTICS a text."""
        n = len(stats)
        scaled = np.clip((stats - self.centre) / self.spread, -3, 3) / 3
        bins = np.stack([np.searchsorted(self.edges[k], stats[:, k], side="right") for k in range(STATISTICS)], axis=1)
        places = np.hstack([np.tile(WORD_BUCKETS + np.arange(STATISTICS), (n, 1)), FIRST_BIN + np.arange(STATISTICS) * BINS + bins])
        return places, np.hstack([scaled, np.full((n, STATISTICS), 0.5)])

    def sums(self, places: np.ndarray, values: np.ndarray, starts: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The raw score of each text, and its factor sums."""
        own, x = self.dense(stats)
        linear = (self.weight[own] * x).sum(axis=1)
        vx = self.factor[own] * x[:, :, None]
        total, squares = vx.sum(axis=1), (vx**2).sum(axis=1)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            at = starts[some]
            linear[some] += np.add.reduceat(self.weight[places] * values, at)
            vw = self.factor[places] * values[:, None]
            total[some] += np.add.reduceat(vw, at, axis=0)
            squares[some] += np.add.reduceat(vw**2, at, axis=0)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1), total

    def scores(self, all_texts: list[str]) -> np.ndarray:
        raw, _ = self.sums(*features(all_texts))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(places: np.ndarray, values: np.ndarray, starts: np.ndarray, stats: np.ndarray, labels: np.ndarray) -> Model:
    """Logistic loss, minibatches, Adagrad; the same result for the same rows in the same order."""
    centre, spread = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    rng = np.random.default_rng(0)
    model = Model(float(np.log((labels.sum() + 1) / ((1 - labels).sum() + 1))), np.zeros(FEATURES), rng.normal(0, 0.05, (FEATURES, FACTORS)), centre, spread, np.ascontiguousarray(edges))
    own, x = model.dense(stats)
    gw, gv, gb = np.full(FEATURES, 1e-3), np.full((FEATURES, FACTORS), 1e-3), 1e-3
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(labels)) if len(labels) >= BATCH else LEAST_STEPS)):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            counts = np.diff(starts)[rows]
            take = ranges(starts[rows], counts)
            raw, total = model.sums(places[take], values[take], offsets_of(counts), stats[rows])
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[rows]
            who = np.concatenate([np.repeat(np.arange(len(rows)), 2 * STATISTICS), np.repeat(np.arange(len(rows)), counts)])
            place = np.concatenate([own[rows].ravel(), places[take]])
            value = np.concatenate([x[rows].ravel(), values[take]])
            touched, back = np.unique(place, return_inverse=True)
            ex = error[who] * value
            w = np.bincount(back, weights=ex) / len(rows) + DECAY * model.weight[touched]
            v = np.stack([np.bincount(back, weights=ex * (total[who, f] - model.factor[place, f] * value)) for f in range(FACTORS)], axis=1) / len(rows) + DECAY * model.factor[touched]
            gw[touched] += w**2
            gv[touched] += v**2
            model.weight[touched] -= RATE * w / np.sqrt(gw[touched])
            model.factor[touched] -= RATE * v / np.sqrt(gv[touched])
            b = error.mean()
            gb += b * b
            model.bias -= RATE * b / np.sqrt(gb)
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """``labels``: doc_id and quality (0 or 1) of the documents to learn from. None without any."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marked.count()
    if not n:
        return None
    chosen = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, SAMPLE_DOCS * 1_000_000 // n)))
    sample = documents(docs).join(F.broadcast(chosen), "doc_id")  # SAMPLE_DOCS rows, give or take their square root

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, _, starts, stats = features(texts(batch))
            bounds = starts.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([places[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                ["doc_id", "quality", "places", "stats"],
            )

    rows = sorted(sample.mapInArrow(lean(task), "doc_id long, quality int, places binary, stats binary").collect())
    if not rows:
        return None
    each = [np.frombuffer(r.places, "<i4").astype(np.int64) for r in rows]
    counts = np.array([len(p) for p in each], np.int64)
    values = np.repeat(1 / np.sqrt(np.maximum(counts, 1)), counts)
    stats = np.array([np.frombuffer(r.stats) for r in rows])
    return train(np.concatenate(each), values, offsets_of(counts), stats, np.array([float(r.quality > 0) for r in rows]))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score from 0 to 1) of each document."""
    if model is None:
        return documents(docs).select("doc_id", F.lit(0.5).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(texts(batch)))], ["doc_id", "score"])

    return documents(docs).mapInArrow(task, "doc_id long, score double")
