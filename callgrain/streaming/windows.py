"""Windowed monitors in event time. All of them aggregate partially before the shuffle, so a hot tenant is merged counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import predicates as P
from callgrain.streaming.source import WATERMARK


def failure_rate_windows(
    calls: DataFrame, window: str = f"{V.SLA_WINDOW_MINUTES} minutes", slide: str = "1 minute", threshold: float = V.SLA_MAX_FAILURE_PCT, delay: str = WATERMARK
) -> DataFrame:
    """(owner_id, at, total, failed, rate_pct) of the windows that breach: at least five calls, rate strictly above the threshold."""
    rows = calls.where(P.finished()).withWatermark("started_at", delay)
    agg = rows.groupBy(F.window("started_at", window, slide), "owner_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed")
    )
    rate = F.col("failed") * 100.0 / F.col("total")
    return agg.select("owner_id", F.col("window.end").alias("at"), "total", "failed", rate.alias("rate_pct")).where(
        (F.col("total") >= V.SLA_MIN_CALLS) & (F.col("rate_pct") > threshold)
    )


def hourly_accuracy(labelled: DataFrame, delay: str = WATERMARK) -> DataFrame:
    """Accuracy per closed hour. ``labelled``: (started_at, truth, predicted)."""
    agg = labelled.withWatermark("started_at", delay).groupBy(F.window("started_at", "1 hour")).agg(
        F.count("*").alias("total"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct")
    )
    return agg.select(F.col("window.start").alias("bucket"), "total", "correct")


def rolling_usage(calls: DataFrame, window: str = "24 hours", slide: str = "1 hour", limit: int = V.DAILY_CALL_LIMIT, delay: str = WATERMARK) -> DataFrame:
    """Calls of each tenant in a rolling day and what is left of the quota."""
    agg = calls.withWatermark("started_at", delay).groupBy(F.window("started_at", window, slide), "owner_id").agg(F.count("*").alias("used"))
    return agg.select("owner_id", F.col("window.end").alias("at"), "used", F.greatest(F.lit(0), F.lit(limit) - F.col("used")).alias("remaining"))


def daily_spend(ledger: DataFrame, cap: float = V.DAILY_SPEND_CAP_USD, delay: str = WATERMARK) -> DataFrame:
    """Spend per day over a ledger stream (at, cost_usd), against the daily cap."""
    agg = ledger.withWatermark("at", delay).groupBy(F.window("at", "1 day")).agg(F.sum("cost_usd").alias("spent_usd"))
    return agg.select(F.col("window.start").alias("day"), "spent_usd", (F.col("spent_usd") >= cap).alias("over_cap"))


def activity_sessions(events: DataFrame, gap: str = "5 minutes", delay: str = WATERMARK) -> DataFrame:
    """Bursts of a tenant's activity separated by pauses longer than ``gap``."""
    agg = events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "owner_id").agg(F.count("*").alias("n"))
    return agg.select("owner_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def first_requests(requests: DataFrame, key: list[str], delay: str = WATERMARK) -> DataFrame:
    """Idempotent ingest: one row per key while the watermark holds its first one."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def affected_by_outage(calls: DataFrame, outages: DataFrame, max_seconds: int = V.OUTAGE_MAX_SECONDS, delay: str = WATERMARK) -> DataFrame:
    """Calls that started while an outage window of their tenant ran: a bounded stream-stream interval join.

    ``outages``: (owner_id, enabled_at, seconds). Windows never exceed
    ``max_seconds``, which bounds the state of both sides.
    """
    c = calls.withWatermark("started_at", delay)
    o = outages.select(F.col("owner_id").alias("o_owner"), "enabled_at", F.least(F.lit(max_seconds), F.greatest(F.lit(1), F.col("seconds"))).alias("lasts")).withWatermark("enabled_at", delay)
    during = (
        (F.col("owner_id") == F.col("o_owner")) & (F.col("started_at") >= F.col("enabled_at"))
        & (F.col("started_at") <= F.col("enabled_at") + F.expr(f"INTERVAL {max_seconds} SECONDS"))
        & (F.unix_micros("started_at") <= F.unix_micros("enabled_at") + F.col("lasts") * 1_000_000)
    )
    return c.join(o, during, "left_semi")
