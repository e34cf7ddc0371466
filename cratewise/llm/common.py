"""What the operators of this subpackage share: the rows they take, and small numpy helpers.

Rows an operator takes: those with a non-null id. An id is expected once; where an id repeats, the row with the
smallest text (nulls count as smallest) stands for it. Other columns are neither read nor returned, so a clash of
names with an operator's own columns cannot occur.
"""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task holds as Python strings at a time, besides its Arrow batch.
SLICE_BYTES = 4 << 20
#: What a Python worker remembers from task to task: one thing, which the next operator to run in that worker lets go.
_REMEMBERED: dict[str, object] = {}


def keyed(df: DataFrame, key: str, **kinds: str) -> DataFrame:
    """(key as long, the columns ``kinds`` cast) of the rows with a key; one row a key. The ids are read alone to see
    whether any repeats."""
    rows = df.select(F.col(key).cast("long").alias(key), *(F.col(c).cast(kind).alias(c) for c, kind in kinds.items())).where(F.col(key).isNotNull())
    n, different = rows.agg(F.count(F.lit(1)), F.countDistinct(key)).first()
    if n == different:
        return rows
    return rows.groupBy(key).agg(F.min(F.struct(*kinds)).alias("row")).select(key, *(F.col(f"row.{c}").alias(c) for c in kinds))


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs``, one row a document."""
    return keyed(docs, "doc_id", text="string")


def whole_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, one row a document."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name != "doc_id"}
    return keyed(docs, "doc_id", **{"text": kinds.pop("text")}, **kinds).select(*docs.columns)


def keep_rows(docs: DataFrame, decide: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows whose text ``decide`` keeps; null is judged as an empty text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(decide(texts(batch)), pa.bool_()))

    return docs.mapInArrow(lean(task), docs.schema)


def remembered(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gave when this worker first asked for ``key``; whatever else it remembered is let go."""
    if key not in _REMEMBERED:
        forget()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def forget() -> None:
    _REMEMBERED.clear()
    give_back()


def give_back() -> None:
    """Return what this process has freed to the system; Arrow and the C library would keep it, at every worker of an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU's alone has it
    if trim is not None:
        trim(0)


def lean(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``task`` in a worker that remembers nothing, before and after: Spark uses a worker again for whatever comes next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished plans now. It does so when the driver collects their garbage, which
    can be long after; until then they take up executors' disks. The last plan is held by its end-of-query events for a
    moment, hence the second time."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that ``column`` holds about ``size`` bytes at most, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(lengths) - lengths) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(start, end - start)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[0], starts[0]+1, … for lengths[0] of them, then those of starts[1], and so on."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1], dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """0 and the running sum."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number
