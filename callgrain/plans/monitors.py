"""Trailing rates, cooldowns, quotas and interval joins over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.functions.columns import micros
from callgrain.operators import intervals as I
from callgrain.operators import monitors as M
from callgrain.plans.ledger import newest, rounded
from callgrain.plans.registry import Catalog
from callgrain.sources.views import calls_view, table

catalog = Catalog()
q = catalog.query

WINDOW_MIN = 1440  # the test events are minutes apart, so the trailing window is a day
CONFIG = """SELECT DISTINCT user_id AS owner_id, 10.0 + user_id % 20 AS pct, 720 + 60 * (user_id % 12) AS mins FROM events WHERE user_id % 3 = 0"""
RATES = f"""SELECT id, owner_id, epoch_us(started_at) AS at_us, count(*) OVER w AS total, count(*) FILTER (WHERE status = 'failed') OVER w AS failed
 FROM calls_v WHERE status IN ('completed', 'failed') WINDOW w AS (PARTITION BY owner_id ORDER BY started_at RANGE BETWEEN INTERVAL '{WINDOW_MIN * 60 - 1}.999999 seconds' PRECEDING AND CURRENT ROW)"""


def config(spark, d):
    return table(spark, d, "events").where("user_id % 3 = 0").select(F.col("user_id").alias("owner_id")).distinct().select(
        "owner_id", (F.lit(10.0) + F.col("owner_id") % 20).alias("max_failure_rate_pct"), (720 + 60 * (F.col("owner_id") % 12)).cast("int").alias("window_minutes"))


def rates(spark, d):
    return M.failure_rate_at_every_call(calls_view(spark, d), WINDOW_MIN * M.MINUTE)


@q("a14_j03_sla_status", f"""
WITH cfg AS ({CONFIG}), t AS (SELECT max(started_at) AS as_of FROM calls_v),
c AS (SELECT c.owner_id, status, COALESCE(pct, 5.0) AS pct, COALESCE(mins, 60) AS mins, started_at > as_of - to_minutes(COALESCE(mins, 60)) AS recent FROM calls_v c LEFT JOIN cfg USING (owner_id), t WHERE status IN ('completed', 'failed')),
g AS (SELECT owner_id, pct, mins, count(*) FILTER (WHERE recent) AS total, count(*) FILTER (WHERE recent AND status = 'failed') AS failed FROM c GROUP BY 1, 2, 3)
SELECT owner_id, pct AS max_failure_rate_pct, mins AS window_minutes, total, failed, round(COALESCE(100.0 * failed / nullif(total, 0), 0), 9) AS observed_pct, total >= 5 AND COALESCE(100.0 * failed / nullif(total, 0), 0) > pct AS breached FROM g
""", ("calls_v",))
def sla_status(spark, d):
    calls = calls_view(spark, d)
    return rounded(M.sla_status(calls, config(spark, d), newest(calls)))


@q("w01_trailing_failure_rate", f"SELECT id, owner_id, at_us, total, failed, round(100.0 * failed / total, 9) AS rate_pct FROM ({RATES}) r", ("calls_v",))
def trailing_failure_rate(spark, d):
    return rounded(rates(spark, d))


@q("w08_r03_breach_cooldown", f"""
WITH RECURSIVE cfg AS ({CONFIG}),
f AS (SELECT owner_id, epoch_us(started_at) AS at_us, status, COALESCE(pct, 5.0) AS pct, COALESCE(mins, {WINDOW_MIN}) * 60000000 AS w FROM calls_v LEFT JOIN cfg USING (owner_id) WHERE status IN ('completed', 'failed')),
b AS (SELECT DISTINCT owner_id, at_us FROM (SELECT x.owner_id, x.at_us, x.pct, count(*) AS total, count(*) FILTER (WHERE y.status = 'failed') AS failed
  FROM (SELECT DISTINCT owner_id, at_us, pct, w FROM f) x JOIN f y ON y.owner_id = x.owner_id AND y.at_us > x.at_us - x.w AND y.at_us <= x.at_us GROUP BY ALL) r WHERE total >= 5 AND 100.0 * failed / total > pct),
nx AS (SELECT owner_id, at_us, min(at_us) OVER (PARTITION BY owner_id ORDER BY at_us RANGE BETWEEN 10800000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM b),
k AS (SELECT owner_id, min(at_us) AS at_us FROM b GROUP BY 1 UNION ALL SELECT k.owner_id, nx.nxt FROM k JOIN nx ON nx.owner_id = k.owner_id AND nx.at_us = k.at_us WHERE nx.nxt IS NOT NULL)
SELECT owner_id, at_us FROM k
""", ("calls_v",))
def breach_cooldown(spark, d):
    own = M.failure_rate_at_every_call(calls_view(spark, d), WINDOW_MIN * M.MINUTE, config(spark, d))
    return M.breaches(own, config(spark, d), cooldown_us=3 * M.HOUR)


@q("w18_debounce", """
WITH RECURSIVE b AS (SELECT DISTINCT event_type, epoch_us(ts) AS at_us FROM events),
nx AS (SELECT event_type, at_us, min(at_us) OVER (PARTITION BY event_type ORDER BY at_us RANGE BETWEEN 1800000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM b),
k AS (SELECT event_type, min(at_us) AS at_us FROM b GROUP BY 1 UNION ALL SELECT k.event_type, nx.nxt FROM k JOIN nx ON nx.event_type = k.event_type AND nx.at_us = k.at_us WHERE nx.nxt IS NOT NULL)
SELECT event_type, at_us FROM k
""")
def debounce(spark, d):
    rows = table(spark, d, "events").select("event_type", micros("ts").alias("at_us"))
    return M.greedy_spacing(rows, key="event_type", at="at_us", gap_us=30 * M.MINUTE)


ADMITTED = """
WITH RECURSIVE e AS (SELECT event_id AS id, event_type AS address, epoch_us(ts) AS us, event_id % 4 + 1 AS units, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT id, address, us, units, rn, units <= 40 AS accepted, CASE WHEN units <= 40 THEN [{'us': us, 'units': units}] ELSE [] END AS taken FROM e WHERE rn = 1
 UNION ALL SELECT id, address, us, units, rn, used + units <= 40, CASE WHEN used + units <= 40 THEN list_append(recent, {'us': us, 'units': units}) ELSE recent END
 FROM (SELECT e.*, list_filter(r.taken, lambda x: x.us > e.us - 21600000000) AS recent, coalesce(list_sum(list_transform(list_filter(r.taken, lambda x: x.us > e.us - 21600000000), lambda x: x.units)), 0) AS used
  FROM r JOIN e ON e.address = r.address AND e.rn = r.rn + 1) x)
"""


@q("w19_quota_replay", f"{ADMITTED} SELECT id, address, us AS at_us, units, accepted FROM r")
def quota_replay(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("address"), micros("ts").alias("at_us"), (F.col("event_id") % 4 + 1).alias("units"))
    return M.quota_replay(rows, key="address", at="at_us", tie="id", units="units", window_us=6 * M.HOUR, max_units=40)


@q("w20_live_feed", """
SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) x WHERE rank <= 5
""")
def live_feed(spark, d):
    return M.latest_per_tenant(table(spark, d, "events"), 5).select("user_id", "event_id", "rank")


@q("j11_outage_windows", """
SELECT DISTINCT c.id, c.owner_id FROM calls_v c JOIN (SELECT user_id AS owner_id, ts + INTERVAL 1 HOUR AS lo, ts + INTERVAL 1 HOUR + to_seconds(least(43200, greatest(1, CAST(value * 40 AS BIGINT)))) AS hi FROM events) o
 ON o.owner_id = c.owner_id AND c.started_at BETWEEN o.lo AND o.hi
""", ("calls_v",))
def outage_windows(spark, d):
    outages = table(spark, d, "events").select(
        F.col("user_id").alias("owner_id"), F.expr("ts + INTERVAL 1 HOUR").alias("enabled_at"), F.round(F.col("value") * 40).cast("bigint").alias("seconds"))
    return M.affected_by_outage(calls_view(spark, d), outages, max_seconds=43200).select("id", "owner_id")


@q("r04_first_per_key", """
SELECT event_id, arg_min(event_id, (ts, event_id)) OVER (PARTITION BY user_id, k) AS answered_by FROM (SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 5 AS k FROM events) e
""")
def first_per_key(spark, d):
    rows = table(spark, d, "events").select("event_id", "ts", "user_id", (F.get_json_object("props", "$.k").cast("bigint") % 5).alias("k"))
    return M.first_per_idempotency_key(rows, ["user_id", "k"], "ts", "event_id").select("event_id", "answered_by")


def matched(spark, d):
    ev = table(spark, d, "events").select((F.col("user_id") % 40).alias("owner_id"), micros("ts").alias("at"), F.when(F.col("event_id") % 3 == 0, "simultaneous").otherwise("interruption").alias("kind"), "event_type")
    truth, found = ev.where("event_type = 'error'"), ev.where("event_type = 'click'")
    return I.match_events(truth, found, key="owner_id", tolerance=90 * M.MINUTE, span=24 * M.HOUR)


#: First-fit matching of t (owner_id, us, kind, rn) with d (the same, pos): rows m, and scores c of each owner.
FIRST_FIT = """
b AS (SELECT t.owner_id, rn, t.us, t.kind, min(pos) AS lo, max(pos) AS hi FROM t LEFT JOIN d ON d.owner_id = t.owner_id AND d.us BETWEEN t.us - {tolerance} AND t.us + {tolerance} GROUP BY ALL),
r AS (SELECT owner_id, rn, us, kind, lo AS used, coalesce(lo, 0) AS last FROM b WHERE rn = 1
 UNION ALL SELECT b.owner_id, b.rn, b.us, b.kind, CASE WHEN greatest(b.lo, r.last + 1) <= b.hi THEN greatest(b.lo, r.last + 1) END, CASE WHEN greatest(b.lo, r.last + 1) <= b.hi THEN greatest(b.lo, r.last + 1) ELSE r.last END
 FROM r JOIN b ON b.owner_id = r.owner_id AND b.rn = r.rn + 1),
m AS (SELECT r.owner_id, 'truth' AS side, r.us AS "at", r.kind, used IS NOT NULL AS matched, coalesce(d.kind = r.kind, false) AS kind_right FROM r LEFT JOIN d ON d.owner_id = r.owner_id AND d.pos = r.used
 UNION ALL SELECT d.owner_id, 'detected', d.us, d.kind, used IS NOT NULL, false FROM d LEFT JOIN r ON r.owner_id = d.owner_id AND r.used = d.pos),
c AS (SELECT owner_id, count(*) FILTER (WHERE side = 'truth' AND matched) AS tp, count(*) FILTER (WHERE side = 'truth' AND NOT matched) AS fn,
 count(*) FILTER (WHERE side = 'detected' AND NOT matched) AS fp, count(*) FILTER (WHERE kind_right) AS kind_right FROM m GROUP BY 1)
"""
SCORES = "SELECT *, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tp / greatest(1, tp + fp), 9) AS precision FROM c"
MATCHED = f"""
WITH RECURSIVE ev AS (SELECT user_id % 40 AS owner_id, epoch_us(ts) AS us, CASE WHEN event_id % 3 = 0 THEN 'simultaneous' ELSE 'interruption' END AS kind, event_type FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY us, kind) AS rn FROM ev WHERE event_type = 'error'),
d AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY us, kind) AS pos FROM ev WHERE event_type = 'click'),
{FIRST_FIT.format(tolerance=5_400_000_000)}"""


@q("j10_event_matching", f"{MATCHED} SELECT * FROM m")
def event_matching(spark, d):
    return matched(spark, d)


@q("e06_detection_scores", f"{MATCHED} {SCORES}")
def detection_scores(spark, d):
    return rounded(I.detection_scores(matched(spark, d), ["owner_id"]))
