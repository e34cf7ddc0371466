"""Streaming operators through their batch twins (M1–M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cratewise.queries.registry import query
from cratewise.queries.roles import Roles, oracle_stage, stage
from cratewise.streaming import attribution, counters, limits

c = F.col


@query("m1_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def m1(r: Roles):
    return counters.daily_counts(r.events, "ts", "event_type")


@query("m1_hourly_counts", "SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def m1b(r: Roles):
    return counters.hourly_counts(r.events, "ts", "event_type", ["click", "view"])


@query("m1_sliding_counts", """
    SELECT strftime(s, '%Y-%m-%dT%H') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 AS INTEGER)), date_trunc('day', ts) + to_hours(CAST(floor(hour(ts) / 6) * 6 - 6 AS INTEGER))]) AS s FROM events) GROUP BY 1, 2""")
def m1c(r: Roles):
    out = counters.window_counts(r.events, "ts", "event_type", "12 hours", "6 hours")
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd'T'HH"))


@query("m2_newest_days", """
    WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT * FROM d WHERE day IN (SELECT DISTINCT day FROM d ORDER BY day DESC LIMIT 9)""")
def m2(r: Roles):
    return counters.newest(counters.daily_counts(r.events, "ts", "event_type"), "day", 9)


@query("m3_running_totals", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def m3(r: Roles):
    return counters.totals(counters.daily_counts(r.events, "ts", "event_type"), "event_type")


@query("m4_hourly_latency", """
    SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM (SELECT ts, CAST(floor(value * 10) AS BIGINT) AS ms FROM events) GROUP BY 1""")
def m4(r: Roles):
    samples = r.events.select("ts", F.floor(c("value") * 10).alias("ms"))
    return counters.hourly_latency(counters.latency_counts(samples, "ts", "ms"), "ms")


@query("m4_last_day_latency", """
    WITH h AS (SELECT date_trunc('hour', ts) AS h, CAST(floor(value * 10) AS BIGINT) AS ms FROM events)
    SELECT strftime(h, '%Y-%m-%dT%H') AS hour, count(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95 FROM h WHERE h >= (SELECT max(h) FROM h) - INTERVAL 24 HOUR GROUP BY 1""")
def m4b(r: Roles):
    samples = r.events.select("ts", F.floor(c("value") * 10).alias("ms"))
    return counters.hourly_latency(counters.latency_counts(samples, "ts", "ms"), "ms", counters.TIMING_HOURS)


@query("m5_token_bucket")
def m5(r: Roles):
    # One day counts as one minute, so a synthetic month of events exercises the limit.
    rows = r.events.select("event_id", "user_id", F.floor(F.unix_millis(c("ts").cast("timestamp")) / 1440).alias("ms"))
    return limits.bucket_waits(rows, "user_id", "ms", "event_id", 3.0)


_TAGGED = "SELECT *, CASE WHEN event_type = 'click' THEN list_extract(['x', 'ig', 'tt'], x % 3 + 1) END AS tag, user_id || ':' || x AS session FROM event_k"


@stage("tagged")
def _tagged(r: Roles):
    tag = F.when(c("event_type") == "click", F.element_at(F.array(F.lit("x"), F.lit("ig"), F.lit("tt")), c("x") % 3 + 1))
    return r.event_k.withColumns({"tag": tag, "session": F.concat(c("user_id").cast("string"), F.lit(":"), c("x").cast("string"))})


@query("m6_hourly_funnel", """
    SELECT strftime(ts, '%Y-%m-%dT%H') AS hour, CASE x % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'ig' ELSE 'tt' END AS tag, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view,
      count(*) FILTER (WHERE event_type = 'purchase') AS purchase, round(count(*) FILTER (WHERE event_type = 'purchase') / CAST(nullif(count(*) FILTER (WHERE event_type = 'view'), 0) AS DOUBLE), 6) AS finished_share
    FROM event_k WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2""")
def m6(r: Roles):
    rows = r.event_k.withColumn("tag", F.element_at(F.array(F.lit("x"), F.lit("ig"), F.lit("tt")), c("x") % 3 + 1))
    return counters.funnel(rows, "ts", "tag", "event_type", ["click", "view", "purchase"]).withColumn("finished_share", F.round("finished_share", 6))


@query("m6_counting_faults", """
    SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type = 'purchase') AS finished, count(*) FILTER (WHERE event_type = 'signup') AS built FROM events GROUP BY 1) WHERE finished > built""")
def m6b(r: Roles):
    return counters.more_finished_than_built(r.events, "ts", "event_type", "purchase", "signup")


@query("m7_idempotent_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def m7(r: Roles):
    retried = r.events.unionByName(r.events.where("event_id % 7 = 0"))
    return counters.once_per(retried, ["event_id"], "ts").groupBy("event_type").agg(F.count("*").alias("n"))


oracle_stage("o_source", f"""
    SELECT event_id, session, ts, event_type, CASE WHEN ts < seen + INTERVAL 7 DAY THEN tg END AS source FROM (
      SELECT *, last_value(tag IGNORE NULLS) OVER w AS tg, last_value(CASE WHEN tag IS NOT NULL THEN ts END IGNORE NULLS) OVER w AS seen FROM ({_TAGGED})
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""")
stage("sourced")(lambda r: attribution.current_tag(r.tagged, "user_id", "ts", "event_id", "tag"))


@query("m8_last_touch_source", "SELECT event_id, source FROM o_source")
def m8(r: Roles):
    return r.sourced.select("event_id", "source")


@query("m8_credited_finishes", """
    SELECT s.session, s.source FROM (SELECT session, arg_min(source, ts) FILTER (WHERE source IS NOT NULL OR true) AS x, min(ts) AS f, (SELECT source FROM o_source i WHERE i.session = o.session AND i.event_type = 'view' ORDER BY i.ts LIMIT 1) AS source
      FROM o_source o WHERE event_type = 'view' GROUP BY session) s JOIN (SELECT session, max(ts) AS t FROM o_source WHERE event_type = 'purchase' GROUP BY 1) e ON e.session = s.session WHERE e.t >= s.f AND s.source IS NOT NULL""")
def m8b(r: Roles):
    return attribution.credited_finishes(r.sourced, "session", "ts", "event_type", "view", "purchase")


@query("m9_once_per_key", """
    SELECT day, tag, count(*) AS n FROM (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, user_id, CASE x % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'ig' ELSE 'tt' END AS tag FROM event_k WHERE event_type = 'click') GROUP BY 1, 2""")
def m9(r: Roles):
    rows = r.tagged.where("tag is not null").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return counters.once_per(rows, ["day", "user_id", "tag"], "ts").groupBy("day", "tag").agg(F.count("*").alias("n"))
