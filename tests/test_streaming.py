"""Streams give the same answer as their batch twins."""

import random

from pyspark.sql import functions as F

from cratewise.streaming import attribution, counters, limits


def _events(spark, path):
    rng = random.Random(2)
    rows = [(i, 1_704_067_200 + i * 97, rng.randrange(4), rng.choice(["open", "start", "done"]), rng.randrange(500)) for i in range(1200)]
    df = spark.createDataFrame(rows, "event_id long, s long, user int, event string, ms int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.unionByName(df.where("event_id % 5 = 0")).repartition(3).write.parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_daily_counts_without_retries(spark, tmp_path):
    batch, stream = _events(spark, str(tmp_path / "e"))
    once = counters.once_per(stream, ["event_id"], "ts", "40 days")
    counts = once.groupBy(F.window("ts", "1 day").alias("w"), "event").count().select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event", F.col("count").alias("n"))
    got = {tuple(r) for r in _drain(counts, "daily", "update").groupBy("day", "event").agg(F.max("n").alias("n")).collect()}
    assert got == {tuple(r) for r in counters.daily_counts(batch, "ts", "event").collect()}


def test_newest_windows_are_kept_on_disk(spark, tmp_path):
    _, stream = _events(spark, str(tmp_path / "e"))
    out = str(tmp_path / "days")
    counters.keep_newest(counters.daily_counts(stream, "ts", "event"), out, "day", 1, str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(out).select("day").distinct().count() == 1


def test_token_bucket_walks_each_key_in_order(spark):
    rng = random.Random(4)
    rows = sorted((rng.choice(["hot", "hot", "a", "b"]), rng.randrange(0, 900_000), i) for i in range(600))
    df = spark.createDataFrame(rows, "k string, ms long, id long")
    got = {r["id"]: r["wait"] for r in limits.bucket_waits(df, "k", "ms", "id", 5.0).collect()}
    state = {}
    for k, now, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        tokens, last = state.get(k, (5.0, now))
        tokens, wait = limits.take(tokens, last, now, 5.0)
        state[k] = (tokens, now)
        assert got[i] == wait
    assert any(got.values())


def test_stateful_bucket_on_a_stream(spark, tmp_path):
    path = str(tmp_path / "r")
    base = 1_704_067_200_000
    rows = [("a", base + t) for t in (0, 100, 200, 300, 400)] + [("b", base)]
    df = spark.createDataFrame(rows, "k string, ms long").withColumn("ts", F.timestamp_millis("ms")).drop("ms")
    df.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    out = _drain(limits.stream_waits(stream, "k", "ts", 3.0), "waits", "append").collect()
    assert sorted((r["k"], r["at"] - base, r["wait"] > 0) for r in out) == [
        ("a", 0, False), ("a", 100, False), ("a", 200, False), ("a", 300, True), ("a", 400, True), ("b", 0, False)]


def test_attribution_expires_after_a_week(spark):
    day = 86_400
    rows = [(1, 7, 0, "x"), (2, 7, 6 * day, None), (3, 7, 8 * day, None), (4, 7, 9 * day, "ig"), (5, 7, 9 * day + 1, None), (6, 8, 0, None)]
    df = spark.createDataFrame(rows, "id int, user int, s long, tag string").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["source"] for r in attribution.current_tag(df, "user", "ts", "id", "tag").collect()}
    assert got == {1: "x", 2: "x", 3: None, 4: "ig", 5: "ig", 6: None}


def test_late_requests_take_no_tokens():
    from cratewise.streaming.limits import take

    assert take(2.0, 60_000, 20_000, 3.0) == (1.0, 0)
    assert take(2.0, 60_000, 60_000, 3.0) == (1.0, 0)


# --- streams of several triggers with late and repeated events ---------------------------------------
def _one_by_one(spark, frames, make, mode="append", name="out"):
    """Rows of the stream ``make(source)`` over ``frames``, a trigger each."""
    import tempfile

    folder = tempfile.mkdtemp()
    check = tempfile.mkdtemp()
    source = spark.readStream.schema(frames[0].schema).parquet(folder)
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(folder)
        q = make(source).writeStream.outputMode(mode).option("checkpointLocation", check).foreachBatch(lambda b, e, k=k: b.write.mode("append").parquet(f"{folder}-out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    return spark.read.parquet(f"{folder}-out")


def _made(spark):
    """Frames of events: four in order with events up to 50 minutes late, and one far ahead; and all but that as a batch."""
    rng = random.Random(5)
    base = 1_704_067_200
    schema = "event_id long, user int, tag string, session string, event string, ms int, s long"
    rows = []
    for i in range(900):
        user = rng.randrange(6)
        rows.append((i, user, rng.choice(["x", "ig", None, None, None]), f"{user}:{i // 300}:{rng.randrange(15)}", rng.choice(["open", "start", "done", "built"]), rng.randrange(300), base + i * 1_800 + rng.randrange(900)))
    order = sorted(rows, key=lambda r: r[-1] + rng.random() * 3_000)
    ahead = (10_000, 0, None, "end", "open", 1, base + 400 * 86_400)
    frame = lambda part: spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    frames = [frame(order[k * 225 : (k + 1) * 225] + (order[k * 225 - 9 : k * 225] if k else [])) for k in range(4)]  # each repeats the end of the one before
    return frame(rows), [*frames, frame([ahead]), frame([(10_001, *ahead[1:-1], ahead[-1] + 86_400)])]


def test_stream_of_latency_equals_the_batch(spark):
    batch, frames = _made(spark)
    once = lambda e: counters.once_per(e, ["event_id"], "ts", "2 hours")
    out = _one_by_one(spark, frames, lambda e: counters.streamed_latency(once(e), "ts", "ms", None))
    want = {tuple(r) for r in counters.hourly_latency(counters.latency_counts(batch, "ts", "ms"), "ms").select("hour", "n", "p50", "p95").collect()}
    got = [tuple(r) for r in out.select("hour", "n", "p50", "p95").collect() if not r.hour.startswith("2025")]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in counters.streamed_latency(batch, "ts", "ms").collect()} == want


def test_stream_of_the_funnel_and_its_alert_equal_the_batch(spark):
    batch, frames = _made(spark)
    once = lambda e: counters.once_per(e, ["event_id"], "ts", "2 hours")
    steps = ["open", "start", "done"]
    out = _one_by_one(spark, frames, lambda e: counters.funnel(once(e), "ts", "tag", "event", steps, None))
    names = ["hour", "tag", *steps, "finished_share"]
    got = [tuple(r) for r in out.select(*names).collect() if not r.hour.startswith("2025")]
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in counters.funnel(batch, "ts", "tag", "event", steps).select(*names).collect()}
    out = _one_by_one(spark, frames, lambda e: counters.more_finished_than_built(once(e), "ts", "event", "done", "built", None))
    want = {tuple(r) for r in counters.more_finished_than_built(batch, "ts", "event", "done", "built").collect()}
    assert {tuple(r) for r in out.select("day", "finished", "built").collect()} == want and want


def test_totals_of_a_stream_in_complete_mode(spark):
    batch, frames = _made(spark)
    out = _one_by_one(spark, frames[:4], lambda e: counters.streamed_totals(counters.once_per(e, ["event_id"], "ts", "2 hours"), "event"), "update")
    assert {tuple(r) for r in out.groupBy("event").agg(F.max("n")).collect()} == {tuple(r) for r in counters.totals(counters.daily_counts(batch, "ts", "event"), "event").collect()}


def test_stream_of_credits_equals_the_batch(spark):
    batch, frames = _made(spark)
    out = _one_by_one(spark, frames, lambda e: attribution.stream_credits(e, "user", "ts", "event_id", "tag", "session", "event", "start", "done", days=7, delay="2 hours"))
    tagged = attribution.current_tag(batch, "user", "ts", "event_id", "tag")
    want = {tuple(r) for r in attribution.credited_finishes(tagged, "session", "ts", "event", "start", "done").collect()}
    got = [tuple(r) for r in out.select("session", "source").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
