"""Streaming monitors run over the event table as a bounded stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.functions.columns import micros
from callgrain.operators import calibration
from callgrain.plans.monitors import ADMITTED, CONFIG, WINDOW_MIN, config
from callgrain.plans.registry import Catalog
from callgrain.sources.views import calls_from_events, table
from callgrain.streaming import ingest, source, stateful, windows

catalog = Catalog()
q = catalog.query
EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"  # watermark once everything was read


def events(spark, d):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", source.ROCKSDB)
    return source.event_stream(spark, d, EVENTS, glob="events.parquet")


def calls(spark, d):
    c = calls_from_events(events(spark, d))
    return c.withColumns({"started_at": F.col("started_at").cast("timestamp"), "ended_at": F.col("ended_at").cast("timestamp")})


def at_us(df, *cols):
    return df.withColumns({c: micros(c) for c in cols})


@q("r01_tenant_stream", "SELECT event_id, event_type FROM events WHERE user_id = 7")
def tenant_stream(spark, d):
    own = source.for_tenant(events(spark, d).withColumnRenamed("user_id", "owner_id"), 7)
    return source.run_to_table(own.select("event_id", "event_type"), "tenant")


@q("r02_failure_rate_windows", f"""
WITH w AS (SELECT owner_id, status, unnest(range(CAST(epoch(date_trunc('hour', started_at)) AS BIGINT) - 23 * 3600, CAST(epoch(date_trunc('hour', started_at)) AS BIGINT) + 3600, 3600)) + 86400 AS end_s FROM calls_v WHERE status IN ('completed', 'failed'))
SELECT owner_id, end_s * 1000000 AS at, count(*) AS total, count(*) FILTER (WHERE status = 'failed') AS failed, round(100.0 * count(*) FILTER (WHERE status = 'failed') / count(*), 9) AS rate_pct FROM w
WHERE end_s <= epoch({CLOSED}) GROUP BY 1, 2 HAVING count(*) >= 5 AND 100.0 * count(*) FILTER (WHERE status = 'failed') / count(*) > 20
""", ("calls_v",))
def failure_rate_windows(spark, d):
    out = windows.failure_rate_windows(calls(spark, d), window="24 hours", slide="1 hour", threshold=20.0)
    return at_us(source.run_to_table(out, "rates"), "at").withColumn("rate_pct", F.round("rate_pct", 9))


@q("r02_trailing_rate", f"""
WITH cfg AS ({CONFIG}),
f AS (SELECT id, owner_id, epoch_us(started_at) AS at_us, status, COALESCE(mins, {WINDOW_MIN}) * 60000000 AS w FROM calls_v LEFT JOIN cfg USING (owner_id) WHERE status IN ('completed', 'failed')),
n AS (SELECT x.id, x.owner_id, x.at_us, count(*) AS total, count(*) FILTER (WHERE y.status = 'failed') AS failed FROM f x JOIN f y ON y.owner_id = x.owner_id AND y.at_us > x.at_us - x.w AND y.at_us <= x.at_us GROUP BY ALL)
SELECT *, round(100.0 * failed / total, 9) AS rate_pct FROM n WHERE at_us <= ((SELECT max(at_us) FROM f) // 1000 - 600000) * 1000
""", ("calls_v",))
def trailing_rate(spark, d):
    own = config(spark, d).select("owner_id", "window_minutes")
    out = stateful.trailing_rates(calls(spark, d), own, window_us=WINDOW_MIN * 60 * stateful.MICROS)
    return source.run_to_table(out, "trailing").withColumn("rate_pct", F.round("rate_pct", 9))


@q("r03_stream_cooldown", """
WITH RECURSIVE b AS (SELECT DISTINCT user_id AS key, epoch_us(ts) AS at_us FROM events WHERE event_type = 'error' AND epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events WHERE event_type = 'error')),
nx AS (SELECT key, at_us, min(at_us) OVER (PARTITION BY key ORDER BY at_us RANGE BETWEEN 86400000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM b),
k AS (SELECT key, min(at_us) AS at_us FROM b GROUP BY 1 UNION ALL SELECT k.key, nx.nxt FROM k JOIN nx ON nx.key = k.key AND nx.at_us = k.at_us WHERE nx.nxt IS NOT NULL)
SELECT key, at_us FROM k
""")
def stream_cooldown(spark, d):
    rows = events(spark, d).where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = stateful.spaced(rows, key="user_id", at="ts", tie="event_id", gap_us=24 * 3600 * stateful.MICROS, delay="0 seconds")
    return source.run_to_table(kept, "cooldown").select("key", "at_us")


@q("r04_stream_idempotent", "SELECT DISTINCT user_id * 1000 + event_id // 20 AS request FROM events")
def stream_idempotent(spark, d):
    rows = events(spark, d).select((F.col("user_id") * 1000 + F.expr("event_id div 20")).alias("request"), F.col("ts").cast("timestamp").alias("ts"))
    return source.run_to_table(windows.first_requests(rows, ["request"], delay="400 days").select("request"), "idempotent")


@q("r04_first_request_wins", """
SELECT event_id AS id, arg_min(event_id, (event_id % 4, ts, event_id)) OVER (PARTITION BY user_id, k) AS answered_by
FROM (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS k FROM events) e
""")
def first_request_wins(spark, d):
    """Requests of a key come in four runs; the table of accepted requests decides, without any state of the stream."""
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("owner_id"),
        (F.get_json_object("props", "$.k").cast("bigint") % 50).alias("k"))
    folder = source.run_in_steps(
        rows.withColumn("step", F.col("id") % 4), "step", 4, "requests", lambda stream, out: ingest.accept_once(stream, out, ["owner_id", "k"]))
    return ingest.answered(rows, spark.read.parquet(folder), ["owner_id", "k"]).select("id", "answered_by")


@q("r12_late_and_repeated_rows", """
WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us, CAST(floor((epoch_us(ts) - lo) * 4.0 / (hi - lo + 1)) AS BIGINT) + CAST(event_id % 10 = 0 AS BIGINT) AS step
  FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events) r),
a AS (SELECT * FROM e UNION ALL SELECT event_id, event_type, us, step + 1 FROM e WHERE event_id % 7 = 0),
w AS (SELECT s.step, coalesce((SELECT max(us) FROM a WHERE a.step < s.step) // 1000 - 172800000, 0) * 1000 AS wm FROM (SELECT DISTINCT step FROM a) s)
SELECT DISTINCT event_id, event_type FROM a JOIN w USING (step) WHERE us > wm
""")
def late_and_repeated_rows(spark, d):
    """Every tenth event comes one run late, every seventh comes again in the next run; the watermark is two days behind."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = (rows.agg(f(micros("ts"))).scalar() for f in (F.min, F.max))
    step = F.floor((micros("ts") - lo) * 4.0 / (hi - lo + 1)).cast("bigint") + (F.col("event_id") % 10 == 0).cast("bigint")
    first = rows.withColumn("step", step)
    again = first.where("event_id % 7 = 0").withColumn("step", F.col("step") + 1)
    folder = source.run_in_steps(
        first.unionByName(again), "step", 6, "late",
        lambda stream, out: ingest.on_time_once(stream, ["event_id"], "ts", "2 days").writeStream.format("parquet").option("path", out))
    return spark.read.parquet(folder).select("event_id", "event_type")


@q("r05_hourly_accuracy", f"""
SELECT epoch_us(date_trunc('hour', started_at)) AS bucket, count(*) AS total, count(*) FILTER (WHERE COALESCE(injected_fault, 'ok') = predicted_category) AS correct FROM calls_v
WHERE status IN ('completed', 'failed') AND predicted_category IS NOT NULL AND (injected_fault IS NOT NULL OR label_source = 'control')
 AND date_trunc('hour', started_at) + INTERVAL 1 HOUR <= (SELECT max(started_at) - INTERVAL 10 MINUTE FROM calls_v WHERE status IN ('completed', 'failed') AND (injected_fault IS NOT NULL OR label_source = 'control')) GROUP BY 1
""", ("calls_v",))
def hourly_accuracy(spark, d):
    return at_us(source.run_to_table(windows.hourly_accuracy(calibration.labelled_calls(calls(spark, d))), "hourly"), "bucket")


@q("r06_rolling_usage", f"""
WITH w AS (SELECT owner_id, unnest(range(CAST(epoch(date_trunc('hour', started_at)) AS BIGINT) - 23 * 3600, CAST(epoch(date_trunc('hour', started_at)) AS BIGINT) + 3600, 3600)) + 86400 AS end_s FROM calls_v)
SELECT owner_id, end_s * 1000000 AS at, count(*) AS used, greatest(0, 25 - count(*)) AS remaining FROM w WHERE end_s <= epoch({CLOSED}) GROUP BY 1, 2
""", ("calls_v",))
def rolling_usage(spark, d):
    return at_us(source.run_to_table(windows.rolling_usage(calls(spark, d)), "usage"), "at")


@q("r06_daily_spend", f"SELECT epoch_us(date_trunc('day', ts)) AS day, round(sum(value / 10000), 6) AS spent_usd, sum(value / 10000) >= 5 AS over_cap FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {CLOSED} GROUP BY 1, date_trunc('day', ts)")
def daily_spend(spark, d):
    ledger = calls(spark, d).select(F.col("started_at").alias("at"), F.col("total_cost_usd").alias("cost_usd"))
    return at_us(source.run_to_table(windows.daily_spend(ledger), "spend"), "day").withColumn("spent_usd", F.round("spent_usd", 6))


@q("r07_stream_admission", f"{ADMITTED} SELECT address AS key, us AS at_us, id AS tie, accepted FROM r WHERE us <= ((SELECT max(us) FROM e) // 1000 - 600000) * 1000")
def stream_admission(spark, d):
    rows = events(spark, d).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 4 + 1).alias("units"))
    return source.run_to_table(stateful.admitted(rows, key="event_type", at="ts", tie="event_id", units="units", window_us=6 * 3600 * stateful.MICROS, max_units=40), "admission")


@q("r08_stream_outages", """
SELECT DISTINCT c.id FROM calls_v c JOIN (SELECT user_id AS owner_id, ts + INTERVAL 1 HOUR AS lo, ts + INTERVAL 1 HOUR + to_seconds(least(43200, greatest(1, CAST(value * 40 AS BIGINT)))) AS hi FROM events) o
 ON o.owner_id = c.owner_id AND c.started_at BETWEEN o.lo AND o.hi
""", ("calls_v",))
def stream_outages(spark, d):
    outages = events(spark, d).select(
        F.col("user_id").alias("owner_id"), F.expr("ts + INTERVAL 1 HOUR").cast("timestamp").alias("enabled_at"), F.round(F.col("value") * 40).cast("bigint").alias("seconds"))
    return source.run_to_table(windows.affected_by_outage(calls(spark, d), outages, max_seconds=43200).select("id"), "outages")


@q("r09_call_assembly", """
WITH e AS (SELECT event_id // 4 AS call_id, event_id % 4 AS k, user_id, epoch_us(ts) AS us, event_id // 4 % 5 = 2 AS open FROM events),
c AS (SELECT call_id, min(us) AS started_us, max(us) FILTER (WHERE k = 3 AND NOT open) AS done_us, string_agg(CASE k WHEN 1 THEN 'stt' ELSE 'llm' END || ':ok', ',' ORDER BY us) FILTER (WHERE k IN (1, 2)) AS stages FROM e WHERE NOT (open AND k = 3) GROUP BY 1)
SELECT call_id, started_us, COALESCE(done_us, started_us + 259200000000) AS ended_us, CASE WHEN done_us IS NULL THEN 'aborted' ELSE 'completed' END AS status, COALESCE(stages, '') AS stages FROM c
WHERE COALESCE(done_us, started_us + 259200000000) // 1000 < (SELECT epoch_ms(max(ts)) - 600000 FROM events WHERE NOT (event_id // 4 % 5 = 2 AND event_id % 4 = 3))
""")
def call_assembly(spark, d):
    e = F.col("event_id")
    kind = F.when(e % 4 == 0, "started").when(e % 4 == 3, "completed").otherwise("stage")
    rows = events(spark, d).where("NOT (event_id div 4 % 5 = 2 AND event_id % 4 = 3)").select(
        F.expr("event_id div 4").alias("call_id"), F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("type"),
        F.when(e % 4 == 1, "stt").when(e % 4 == 2, "llm").alias("stage"), F.when(e % 4 == 3, "completed").when(e % 4 != 0, "ok").alias("status"))
    out = source.run_to_table(stateful.assembled_calls(rows, timeout_ms=3 * 24 * 3600 * 1000), "assembly")
    return out.select("call_id", "started_us", "ended_us", "status", "stages")


@q("r10_activity_sessions", f"""
WITH g AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events) e)
SELECT user_id AS owner_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 6 HOUR) AS ended, count(*) AS n FROM g GROUP BY user_id, s HAVING epoch_ms(max(ts) + INTERVAL 6 HOUR) < (SELECT epoch_ms(max(ts)) - 600000 FROM events)
""")
def activity_sessions(spark, d):
    rows = events(spark, d).select(F.col("user_id").alias("owner_id"), F.col("ts").cast("timestamp").alias("ts"))
    return at_us(source.run_to_table(windows.activity_sessions(rows, gap="6 hours"), "sessions"), "started", "ended")
