"""Last-touch attribution: the newest source tag of a visitor within a week, and credit for finished sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cratewise.operators.ranking import attach
from cratewise.session import fixed, shuffle_width


def current_tag(events: DataFrame, user: str, ts: str, event_id: str, tag: str, days: int = 7) -> DataFrame:
    """``events`` plus ``source``: the newest tag at or before each event, if younger than ``days``.

    A visitor's events spread over several range-partitioned pieces when there are many: each piece finds
    the newest tag inside itself, and takes the newest of the pieces before it otherwise.
    """
    width = shuffle_width(events.sparkSession)
    pieces = fixed(events.repartitionByRange(width, user, ts, event_id).withColumn("_piece", F.spark_partition_id()))
    seen = F.when(F.col(tag).isNotNull(), F.struct(F.col(ts).alias("at"), F.col(tag).alias("tag")))
    inside = Window.partitionBy("_piece", user).orderBy(ts, event_id).rowsBetween(Window.unboundedPreceding, 0)
    local = pieces.withColumn("_own", F.last(seen, ignorenulls=True).over(inside))
    ends = pieces.where(F.col(tag).isNotNull()).groupBy("_piece", user).agg(
        F.max_by(F.struct(F.col(ts).alias("at"), F.col(tag).alias("tag")), F.struct(ts, event_id)).alias("_end")
    )
    present = pieces.select("_piece", user).distinct()
    across = Window.partitionBy(user).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # ≤ width rows
    carried = attach(present, ends, ["_piece", user]).select("_piece", user, F.last("_end", ignorenulls=True).over(across).alias("_carried"))
    newest = attach(local, carried, ["_piece", user]).withColumn("_t", F.coalesce("_own", "_carried"))
    fresh = F.col(ts) < F.col("_t.at") + F.expr(f"INTERVAL {days} DAYS")
    return newest.withColumn("source", F.when(fresh, F.col("_t.tag"))).drop("_piece", "_own", "_carried", "_t")


def credited_finishes(tagged: DataFrame, session: str, ts: str, step: str, start: str, finish: str) -> DataFrame:
    """(session, source) of finished sessions: credit goes to the tag the session's first start carried, once."""
    starts = tagged.where(F.col(step) == start).groupBy(session).agg(F.min_by("source", ts).alias("source"), F.min(ts).alias("_from"))
    ends = tagged.where(F.col(step) == finish).groupBy(session).agg(F.max(ts).alias("_to"))
    return starts.join(ends, session).where("_to >= _from and source is not null").select(session, "source")


DAY_MS = 86_400_000


def stream_credits(
    events: DataFrame, user: str, ts: str, event_id: str, tag: str, session: str, step: str, start: str, finish: str, days: int = 7, delay: str = "1 hour",
) -> DataFrame:
    """(session, source) on a stream: as ``current_tag`` and ``credited_finishes``, each session once, when it finishes.

    A visitor's events wait in state until the watermark has passed them, so that late ones take their place in time;
    repeated ones (by ``event_id``) count once. Kept of a visitor: the newest tag for ``days``, and the tag that each started
    session carries, for ``days`` from its first start. A session that finishes later than that gets no credit.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    keep_ms, names = days * DAY_MS, [event_id, tag, session, step]

    class LastTouch(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", "at long, id string, tag string, session string, step string")
            self.newest = handle.getValueState("newest", "at long, tag string")
            self.started = handle.getMapState("started", "session string", "at long, tag string")

        def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
            edge, last = timerValues.getCurrentWatermarkInMs(), None
            for pdf in rows:
                at = pdf[ts].to_numpy().astype("datetime64[ms]").astype("int64")
                kept = [(int(t), *(None if pd.isna(x) else str(x) for x in row)) for t, row in zip(at, pdf[names].itertuples(index=False)) if t > edge]
                if kept:
                    self.waiting.appendList(kept)
                    last = max(kept[-1][0], *(k[0] for k in kept), last or 0)
            if last is not None:
                self.handle.registerTimer(last)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
            now = expiredTimerInfo.getExpiryTimeInMs()
            listed = sorted(set(self.waiting.get()), key=lambda r: (r[0], len(r[1] or ""), r[1] or ""))
            ready, rest = [r for r in listed if r[0] <= now], [r for r in listed if r[0] > now]
            if ready:
                self.waiting.put(rest) if rest else self.waiting.clear()
            newest, credits_ = (tuple(self.newest.get()) if self.newest.exists() else None), []
            for at, _, label, its_session, its_step in ready:
                if label is not None:
                    newest = (at, label)
                if its_session is None:
                    continue
                if its_step == start and not self.started.containsKey((its_session,)):
                    source = newest[1] if newest and at < newest[0] + keep_ms else None
                    self.started.updateValue((its_session,), (at, source))
                    self.handle.registerTimer(at + keep_ms)
                elif its_step == finish and self.started.containsKey((its_session,)):
                    begun, source = self.started.getValue((its_session,))
                    if begun >= 0 and source is not None:
                        credits_.append((its_session, source))
                        self.started.updateValue((its_session,), (-begun - 1, source))  # credited: kept so that it is once
            if newest and ready:
                self.newest.update(newest)
                self.handle.registerTimer(newest[0] + keep_ms)
            if newest and newest[0] + keep_ms <= now:
                self.newest.clear()
            for (its_session,), (begun, _) in list(self.started.iterator()):
                if (begun if begun >= 0 else -begun - 1) + keep_ms <= now:
                    self.started.removeKey((its_session,))
            if credits_:
                yield pd.DataFrame(credits_, columns=[session, "source"])

        def close(self) -> None:
            pass

    rows: DataFrame = events.withWatermark(ts, delay).select(user, ts, *(F.col(c).cast("string").alias(c) for c in names))
    return rows.groupBy(user).transformWithStateInPandas(LastTouch(), f"{session} string, source string", "append", "EventTime")
