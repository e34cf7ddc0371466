"""Usage counters: the same expressions over a stream (with a watermark) and over a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cratewise.functions.text import utc_day, utc_hour
from cratewise.operators.ranking import prefix_totals

DAYS_KEPT, DAYS_SHOWN, HOURS_KEPT, TIMING_HOURS = 400, 90, 14 * 24, 24


def late_after(events: DataFrame, ts: str, delay: str | None = "1 hour") -> DataFrame:
    """Set a watermark on a stream; a stored table passes through, and so does a stream that has one (no ``delay``)."""
    return events.withWatermark(ts, delay) if delay and events.isStreaming else events


def window_counts(events: DataFrame, ts: str, event: str, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, event, n) per tumbling (or sliding) window."""
    span = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.groupBy(span.alias("_w"), event).agg(F.count("*").alias("n")).select(F.col("_w.start").alias("start"), event, "n")


def daily_counts(events: DataFrame, ts: str, event: str) -> DataFrame:
    counts = window_counts(late_after(events, ts), ts, event, "1 day")
    return counts.select(utc_day(F.col("start")).alias("day"), event, "n")


def hourly_counts(events: DataFrame, ts: str, event: str, hourly: list[str]) -> DataFrame:
    rows = late_after(events.where(F.col(event).isin(*hourly)), ts)
    return window_counts(rows, ts, event, "1 hour").select(utc_hour(F.col("start")).alias("hour"), event, "n")


def newest(counts: DataFrame, window: str, n: int) -> DataFrame:
    """Rows of the newest ``n`` windows; the distinct windows are few however many rows there are."""
    keep = counts.select(window).distinct().orderBy(F.col(window).desc()).limit(n)
    return counts.join(keep, window, "left_semi")


def totals(counts: DataFrame, event: str) -> DataFrame:
    """Running totals since the first window, from the window counts."""
    return counts.groupBy(event).agg(F.sum("n").alias("n"))


def latency_counts(samples: DataFrame, ts: str, ms: str) -> DataFrame:
    """(hour, ms, n): how often each duration occurs; the state of an hour is its distinct durations."""
    rows = late_after(samples, ts)
    return window_counts(rows, ts, ms, "1 hour").select(utc_hour(F.col("start")).alias("hour"), ms, "n")


def hourly_latency(counts: DataFrame, ms: str, hours: int | None = None) -> DataFrame:
    """(hour, n, p50, p95) by nearest rank, of the newest ``hours`` + 1 hours."""
    rows = counts
    if hours is not None:
        last = F.to_timestamp(F.concat("hour", F.lit(":00:00")), "yyyy-MM-dd'T'HH:mm:ss")
        edge = counts.agg(F.max(last).alias("_last"))
        rows = counts.join(F.broadcast(edge), F.lit(True)).where(last >= F.col("_last") - F.expr(f"INTERVAL {hours} HOURS")).drop("_last")
    at = prefix_totals(rows, ["hour"], [F.col(ms).asc()], weight="n", before="_b", total="_n")
    pick = lambda p, name: F.min(F.when(F.col("_b") + F.col("n") >= F.ceil(F.col("_n") * p / 100), F.col(ms))).alias(name)
    return at.groupBy("hour").agg(F.first("_n").alias("n"), pick(50, "p50"), pick(95, "p95"))


def streamed_latency(samples: DataFrame, ts: str, ms: str, delay: str | None = "1 hour") -> DataFrame:
    """(hour, n, p50, p95) by nearest rank, as ``hourly_latency``, in one pass: an hour's state is its exact histogram of
    durations, which merges. On a stream an hour is given out once, when the watermark passes its end."""
    at = lambda p, name: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{ms}`)").alias(name)
    hours = late_after(samples.where(F.col(ms).isNotNull()), ts, delay).groupBy(F.window(ts, "1 hour").alias("_w")).agg(F.count("*").alias("n"), at(0.5, "p50"), at(0.95, "p95"))
    return hours.select(utc_hour(F.col("_w.start")).alias("hour"), "n", "p50", "p95")


def streamed_totals(events: DataFrame, event: str) -> DataFrame:
    """(event, n) since the start of a stream, for complete or update mode; the state is one number an event."""
    return events.groupBy(event).agg(F.count("*").alias("n"))


def once_per(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Count a key once: duplicates (retries, reloads) are dropped, within the watermark on a stream."""
    if events.isStreaming:
        return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def funnel(events: DataFrame, ts: str, tag: str, step: str, steps: list[str], delay: str | None = "1 hour") -> DataFrame:
    """(hour, tag, one count per step, finished_share) of a tagged funnel. On a stream an hour's rows are given out when the
    watermark passes its end."""
    rows = late_after(events.where(F.col(step).isin(*steps)), ts, delay)
    counts = rows.groupBy(F.window(ts, "1 hour").alias("_w"), tag).agg(*[F.count_if(F.col(step) == s).alias(s) for s in steps])
    wide = counts.select(utc_hour(F.col("_w.start")).alias("hour"), tag, *steps)
    return wide.withColumn("finished_share", F.try_divide(F.col(steps[-1]), F.col(steps[-2])))


def more_finished_than_built(events: DataFrame, ts: str, step: str, finished: str, built: str, delay: str | None = "1 hour") -> DataFrame:
    """Days on which more quizzes finished than playlists were built: a counting fault. On a stream an alert a day, when the
    watermark passes the day's end."""
    days = late_after(events.where(F.col(step).isin(finished, built)), ts, delay).groupBy(F.window(ts, "1 day").alias("_w")).agg(
        F.count_if(F.col(step) == finished).alias("finished"), F.count_if(F.col(step) == built).alias("built")
    )
    return days.where("finished > built").select(utc_day(F.col("_w.start")).alias("day"), "finished", "built")


def keep_newest(stream_counts: DataFrame, path: str, window: str, n: int, checkpoint: str) -> StreamingQuery:
    """Write every finished window once under ``path/<window>`` and drop folders older than the newest ``n``.

    A batch that is retried overwrites its own windows, so counts never double.
    """

    def write(batch: DataFrame, _epoch: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(window).parquet(path)
        jvm = spark.sparkContext._jvm
        base = jvm.org.apache.hadoop.fs.Path(path)
        fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        folders = sorted((s.getPath() for s in fs.listStatus(base) if s.getPath().getName().startswith(f"{window}=")), key=lambda x: x.getName())
        for old in folders[:-n]:
            fs.delete(old, True)

    return stream_counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
