"""Token bucket per key in event time: stateful on a stream, segment by segment on a stored table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cratewise.operators.ranking import prefix_totals, row_numbers

IDLE_MS = 60_000  # a bucket left alone for a minute is full again


def take(tokens: float, last_ms: int, now_ms: int, per_minute: float) -> tuple[float, int]:
    """(tokens left, seconds to wait): 0 seconds when the request is allowed. A late request adds no tokens and takes
    none for the time it is late."""
    rate = per_minute / IDLE_MS
    tokens = min(per_minute, tokens + max(0, now_ms - last_ms) * rate)
    if tokens >= 1:
        return tokens - 1, 0
    return tokens, max(1, math.ceil((1 - tokens) / rate / 1000 - 1e-9))


def bucket_waits(requests: DataFrame, key: str, ts_ms: str, event_id: str, per_minute: float) -> DataFrame:
    """(event_id, key, wait) for stored requests.

    After a minute without requests a bucket is full, so a key's requests fall into independent segments;
    segments, not keys, are spread over tasks, and a task walks its rows in order without holding a group.
    """
    rows = requests.select(key, ts_ms, event_id)
    order = [F.col(ts_ms).asc(), F.col(event_id).asc()]
    placed = row_numbers(rows, [key], order, "_i", "_n").drop("_n")
    ahead = placed.select(key, (F.col("_i") + 1).alias("_i"), F.col(ts_ms).alias("_last"))
    gaps = placed.join(ahead, [key, "_i"], "left")
    opens = gaps.withColumn("_opens", (F.col("_last").isNull() | (F.col(ts_ms) - F.col("_last") >= IDLE_MS)).cast("int"))
    counted = prefix_totals(opens, [key], order, weight="_opens", before="_b", total="_t")
    segments = counted.select(key, ts_ms, event_id, (F.col("_b") + F.col("_opens")).alias("_segment"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, tokens, last = None, per_minute, 0
        for pdf in batches:
            waits = []
            for k, segment, now in zip(pdf[key], pdf["_segment"], pdf[ts_ms]):
                if (k, segment) != at:
                    at, tokens, last = (k, segment), per_minute, now
                tokens, wait = take(tokens, last, now, per_minute)
                last = now
                waits.append(wait)
            yield pd.DataFrame({event_id: pdf[event_id], key: pdf[key], "wait": waits})

    sorted_rows = segments.repartition(key, "_segment").sortWithinPartitions(key, "_segment", ts_ms, event_id)
    types = dict(requests.dtypes)
    return sorted_rows.mapInPandas(walk, f"{event_id} {types[event_id]}, {key} {types[key]}, wait long")


def stream_waits(requests: DataFrame, key: str, ts: str, per_minute: float, delay: str = "1 minute") -> DataFrame:
    """(key, at, wait) on a stream: one small state per key, forgotten a minute after its last request."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    class Bucket(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("bucket", "tokens double, at long")

        def handleInputRows(self, k, rows, timer_values):  # noqa: N802
            tokens, last = self.state.get() if self.state.exists() else (per_minute, None)
            # All of the trigger's requests of the key, in time order: chunks come in any order.
            times = np.sort(np.concatenate([pdf[ts].to_numpy().astype("datetime64[ms]").astype("int64") for pdf in rows]))
            waits = []
            for now in times.tolist():
                tokens, wait = take(tokens, now if last is None else last, now, per_minute)
                last = now if last is None else max(last, now)
                waits.append(wait)
            yield pd.DataFrame({key: k[0], "at": times, "wait": waits})
            self.state.update((float(tokens), int(last)))
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(last) + IDLE_MS)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            self.state.clear()
            yield from ()

        def close(self) -> None:
            pass

    types = dict(requests.dtypes)
    rows = requests.withWatermark(ts, delay)
    return rows.groupBy(key).transformWithStateInPandas(
        Bucket(), f"{key} {types[key]}, at long, wait long", "append", "EventTime"
    )
