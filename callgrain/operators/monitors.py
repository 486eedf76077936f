"""Trailing rates, cooldowns, debounce and quota replay over event time.

A tenant may own a third of all rows, so nothing here partitions by the tenant
alone. Trailing windows are cut into time spans with a halo of one window;
"keep one, then wait" folds are split into spans whose effect is summarised as
a small step function before the spans of a tenant are chained.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrain import vocab as V
from callgrain.functions import predicates as P
from callgrain.functions.columns import micros, ratio
from callgrain.operators.ledger import for_every_tenant, since
from callgrain.operators.sequence import islands, per_key_stream, running_sum
from callgrain.sources.settle import settle

MINUTE = 60_000_000
HOUR = 60 * MINUTE
NEVER = -(2**62)


def trailing(df: DataFrame, *, key: str, at: str, window_us: int | Column, counters: Mapping[str, Column], block_us: int = HOUR) -> DataFrame:
    """Counts over (t - window, t] of the same key, at every row; the window may be a column that depends on the key.

    The count is the running sum at t less the running sum at t - window. Each
    instant of a key gives one row with its sums and one that asks for the sum
    a window earlier; running sums are taken in blocks of ``block_us``, so a key
    with very many rows is spread over the blocks of its time.
    """
    width = window_us if isinstance(window_us, Column) else F.lit(window_us)
    points = df.groupBy(key, F.col(at).cast("bigint").alias("__for")).agg(F.max(width.cast("bigint")).alias("__w"), *[F.sum(c).alias(n) for n, c in counters.items()])
    here = points.select(key, "__for", F.col("__for").alias("__t"), F.lit(0).alias("__asks"), *counters)
    earlier = points.select(key, "__for", (F.col("__for") - F.col("__w")).alias("__t"), F.lit(1).alias("__asks"), *[F.lit(0).cast(points.schema[n].dataType).alias(n) for n in counters])
    both = here.unionByName(earlier).withColumn("__block", F.floor(F.col("__t") / block_us).cast("bigint"))
    summed = running_sum(both, key=[key], chunk="__block", order=["__t", "__asks"], sums={f"__{n}": F.col(n) for n in counters})
    counted = summed.groupBy(key, "__for").agg(*[F.sum(F.when(F.col("__asks") == 0, F.col(f"__{n}")).otherwise(-F.col(f"__{n}"))).alias(n) for n in counters])
    return df.withColumn("__for", F.col(at).cast("bigint")).join(counted, [key, "__for"]).select(*df.columns, *counters)


def failure_rate_at_every_call(calls: DataFrame, window_us: int = V.SLA_WINDOW_MINUTES * MINUTE, config: DataFrame | None = None) -> DataFrame:
    """(id, owner_id, at_us, total, failed, rate_pct) for finished calls, over the window of the tenant where ``config`` has one."""
    rows = calls.where(P.finished()).select("id", "owner_id", micros("started_at").alias("at_us"), "status")
    width: int | Column = window_us
    if config is not None:
        rows = rows.join(config.select("owner_id", (F.col("window_minutes").cast("bigint") * MINUTE).alias("own_us")), "owner_id", "left")
        width = F.coalesce("own_us", F.lit(window_us))
    one = F.lit(1).cast("bigint")
    out = trailing(rows, key="owner_id", at="at_us", window_us=width, counters={
        "total": one, "failed": F.when(F.col("status") == "failed", one).otherwise(one - 1)})
    return out.select("id", "owner_id", "at_us", "total", "failed", (F.col("failed") * 100.0 / F.col("total")).alias("rate_pct"))


def with_config(df: DataFrame, config: DataFrame) -> DataFrame:
    """Tenant settings with the defaults for tenants that have none."""
    settings = config.select("owner_id", "max_failure_rate_pct", "window_minutes")
    return df.join(settings, "owner_id", "left").withColumns({
        "max_failure_rate_pct": F.coalesce("max_failure_rate_pct", F.lit(V.SLA_MAX_FAILURE_PCT)),
        "window_minutes": F.coalesce("window_minutes", F.lit(V.SLA_WINDOW_MINUTES)),
    })


def breaching(total: Column, rate: Column, threshold: Column) -> Column:
    return (total >= V.SLA_MIN_CALLS) & (rate > threshold)


def sla_status(calls: DataFrame, config: DataFrame, as_of: Column, tenants: DataFrame | None = None) -> DataFrame:
    """Failure rate of every tenant over its own window ending at ``as_of``. Only calls within the widest window are read.

    ``tenants``: those to report (owner_id); without it all with a finished call, whose names are read from the whole history.
    """
    finished = calls.where(P.finished())
    everyone = with_config((finished if tenants is None else tenants).select("owner_id").distinct(), config)
    widest = F.greatest(F.lit(V.SLA_WINDOW_MINUTES), config.agg(F.max("window_minutes")).scalar()).cast("int")
    recent = since(finished, as_of - F.make_dt_interval(F.lit(0), F.lit(0), widest, F.lit(0)))
    rows = with_config(recent.select("owner_id", "started_at", "status"), config)
    inside = rows.where(micros("started_at") > micros(as_of) - F.col("window_minutes").cast("bigint") * MINUTE)
    counts = inside.groupBy("owner_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "failed").alias("failed"))
    rate = F.coalesce(ratio(F.col("failed") * 100, "total"), F.lit(0.0))
    agg = for_every_tenant(counts, everyone, ["total", "failed"]).join(everyone.withColumnRenamed("owner_id", "__owner"), F.col("owner_id").eqNullSafe(F.col("__owner"))).drop("__owner")
    return agg.select(
        "owner_id", "max_failure_rate_pct", "window_minutes", "total", "failed", rate.alias("observed_pct"), breaching(F.col("total"), rate, F.col("max_failure_rate_pct")).alias("breached"))


# -------------------------------------------------------- keep one, then wait


def _jump(t: np.ndarray, gap: int) -> np.ndarray:
    """Index of the first element at least ``gap`` later (len(t) when there is none)."""
    return np.searchsorted(t, t + gap, side="left")


def exit_steps(t: np.ndarray, start: int, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Step function of one span: last kept time by the earliest time the span may keep.

    Returns (until, exit): an allowed-from time e with until[i-1] < e <= until[i]
    leaves the span with exit[i] as its last kept time; e > until[-1] keeps nothing.
    """
    nxt, n = _jump(t, gap), len(t)
    firsts = min(n, int(np.searchsorted(t, start + gap, side="left")) + 1)
    at = np.arange(firsts)
    while True:
        ahead = nxt[at]
        moving = ahead < n
        if not moving.any():
            break
        at = np.where(moving, ahead, at)
    last_of_run = np.append(np.diff(at) != 0, True)
    return t[:firsts][last_of_run], t[at][last_of_run]


def kept_in_span(t: np.ndarray, allowed_from: int, gap: int) -> np.ndarray:
    nxt, n, out = _jump(t, gap), len(t), []
    i = int(np.searchsorted(t, allowed_from, side="left"))
    while i < n:
        out.append(i)
        i = int(nxt[i])
    return t[out]


def greedy_spacing(df: DataFrame, *, key: str, at: str, gap_us: int, spans: int = 96) -> DataFrame:
    """Times that are kept when a kept one blocks the key for ``gap_us``: (key, at).

    1. distinct times of a key are grouped per span of ``spans`` gaps;
    2. every span is reduced to its step function (entry time -> last kept time);
    3. the step functions of a key are chained in order, which is the only
       sequential part and sees a few numbers per span;
    4. every span replays its own times from its now known entry time.
    """
    width = spans * gap_us
    key_type = df.schema[key].dataType.simpleString()
    grouped = df.groupBy(F.col(key).alias("key"), F.floor(F.col(at) / width).cast("bigint").alias("span")).agg(
        F.array_sort(F.collect_set(F.col(at).cast("bigint"))).alias("times")
    )

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for k, s, times in zip(b["key"], b["span"], b["times"]):
                until, ex = exit_steps(np.asarray(times, dtype=np.int64), int(s) * width, gap_us)
                parts.append(pd.DataFrame({"key": k, "span": s, "until": until, "exit": ex}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, span, entry, taken = NEVER, None, NEVER, False
        owner = None
        for b in batches:
            rows = []
            for k, s, until, ex in zip(b["key"], b["span"], b["until"], b["exit"]):
                if s != span:
                    span, owner, entry, taken = s, k, last if last == NEVER else last + gap_us, False
                    rows.append((owner, span, entry))
                if not taken and until >= entry:
                    last, taken = ex, True
            yield pd.DataFrame(rows, columns=["key", "span", "entry"])

    steps = grouped.mapInPandas(summarise, f"key {key_type}, span bigint, until bigint, exit bigint")
    ordered = steps.repartition("key").sortWithinPartitions("key", "span", "until")
    entries = per_key_stream(ordered, chain, f"key {key_type}, span bigint, entry bigint")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            kept = [kept_in_span(np.asarray(t, dtype=np.int64), int(e), gap_us) for t, e in zip(b["times"], b["entry"])]
            sizes = [len(x) for x in kept]
            yield pd.DataFrame({"key": np.repeat(b["key"].to_numpy(), sizes), "at": np.concatenate(kept) if kept else []})

    kept = grouped.join(entries, ["key", "span"]).mapInPandas(replay, f"key {key_type}, at bigint")
    return kept.select(F.col("key").alias(key), F.col("at").alias(at))


def breaches(rates: DataFrame, config: DataFrame, cooldown_us: int = V.SLA_COOLDOWN_MINUTES * MINUTE) -> DataFrame:
    """Breaches that are recorded: at least five calls, above the threshold, none recorded in the last 15 minutes."""
    hits = with_config(rates, config).where(breaching(F.col("total"), F.col("rate_pct"), F.col("max_failure_rate_pct")))
    return greedy_spacing(hits, key="owner_id", at="at_us", gap_us=cooldown_us)


# ------------------------------------------------------------ quota admission


class Quota:
    """Requests accepted in the last window, and which of the next ones are: those whose units fit beside them."""

    def __init__(self, window_us: int, max_units: int) -> None:
        self.window_us, self.max_units = window_us, max_units
        self.taken: deque[tuple[int, int]] = deque()
        self.used = 0

    def take(self, at: np.ndarray, units: np.ndarray) -> None:
        self.taken.extend(zip(at.tolist(), units.tolist()))
        self.used += int(units.sum())

    def admit(self, at: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Whether each request is accepted, in order. Where not even the smallest fits, those up to the next that leaves the window are passed over at once."""
        accepted = np.zeros(len(at), bool)
        least = int(units.min(initial=self.max_units + 1))
        times, asked, i = at.tolist(), units.tolist(), 0
        while i < len(times):
            t = times[i]
            while self.taken and t - self.taken[0][0] >= self.window_us:
                self.used -= self.taken.popleft()[1]
            if self.used + asked[i] <= self.max_units:
                self.taken.append((t, asked[i]))
                self.used += asked[i]
                accepted[i] = True
            if self.taken and self.used + least > self.max_units:
                i = max(i + 1, int(np.searchsorted(at, self.taken[0][0] + self.window_us, side="left")))
            else:
                i += 1
        return accepted


def quota_replay(
    df: DataFrame, *, key: str, at: str, tie: str, units: str,
    window_us: int = HOUR, max_units: int = V.HOURLY_UNITS_PER_ADDRESS, cell_windows: int = 24, patience: int = 3,
) -> DataFrame:
    """Adds ``accepted``: accepted units of the last window plus the request must not exceed the limit.

    A request whose whole trailing window (accepted or not) fits the limit is
    always accepted, so only *contended* stretches need replay. A stretch ends
    where one full window holds no contended request; the rows of the window
    before its first contended request are its exact starting state.

    A stretch, which may be the whole life of a key, is replayed in time cells of ``cell_windows`` windows, each by a
    task of its own (``_replay_cells``).
    """
    typed = df.withColumns({"__at": F.col(at).cast("bigint"), "__u": F.col(units).cast("bigint")})
    asked = trailing(typed, key=key, at="__at", window_us=window_us, counters={"__asked": F.col("__u")})
    # rows sharing a timestamp count towards each other, which can only mark more rows as contended
    rows = asked.withColumns({"__hot": F.col("__asked") > max_units, "__day": F.floor(F.col("__at") / (24 * window_us)).cast("bigint")})
    hot = rows.where("__hot").select(key, "__at", tie, "__day")
    stretch = islands(
        hot, key=[key], chunk="__day", order=["__at", tie], uses=["__at"],
        starts=lambda cur, prev: cur("__at") - prev("__at") >= window_us, name="__stretch",
    )
    spans = stretch.groupBy(key, "__stretch").agg(F.min("__at").alias("__from"), F.max("__at").alias("__to"))
    # warm-up window before the stretch and everything inside it
    bucket = lambda c: F.floor(c / window_us).cast("bigint")
    spans = spans.select(key, "__stretch", "__from", "__to", F.explode(F.sequence(bucket(F.col("__from")) - 1, bucket(F.col("__to")))).alias("__bucket"))
    touched = rows.withColumn("__bucket", bucket(F.col("__at"))).join(spans, [key, "__bucket"]).where(
        (F.col("__at") > F.col("__from") - window_us) & (F.col("__at") <= F.col("__to"))
    )
    feed = settle(touched.select(
        F.concat_ws("|", F.col(key).cast("string"), F.col("__stretch").cast("string")).alias("key"), F.col(key).alias("owner"),
        F.col("__at").alias("at"), F.lit(1).alias("side"), F.col(tie).alias("tie"), F.col("__u").alias("units"),
    ))
    refused = _replay_cells(feed, window_us, max_units, cell_windows * window_us, patience)
    refused = refused.select(F.col("owner").alias(key), F.col("at").alias("__at"), F.col("tie").alias(tie), F.lit(True).alias("__refused")).distinct()
    return typed.join(refused, [key, "__at", tie], "left").select(*df.columns, F.col("__refused").isNull().alias("accepted"))


def _replay_cells(feed: DataFrame, window_us: int, max_units: int, width: int, patience: int) -> DataFrame:
    """The refused rows of ``feed``: (key, owner, at, side, tie, units).

    What a cell has to know of the ones before are the accepted requests of the last window, at most as many as the limit.
    Every cell is first replayed as if that were empty, then again from what its predecessor left, as long as that
    differs from what it was replayed from. As a cell forgets its start after some windows of irregular requests, two or three
    rounds are enough as a rule, and all cells run at the same time. The result is exact: it stands only when each cell has run
    from what its predecessor left. Where starts are not forgotten (requests as regular as a clock), cells become twice as
    wide after ``patience`` rounds, so the number of rounds grows with the logarithm of the number of cells; only
    cells that haven't settled run again.
    """
    kinds = {c: feed.schema[c].dataType.simpleString() for c in ("owner", "tie")}
    out_schema = f"key string, cell bigint, owner {kinds['owner']}, at bigint, side int, tie {kinds['tie']}, units bigint"
    fields = ["key", "cell", "owner", "at", "side", "tie", "units"]
    origin = feed.groupBy("key").agg(F.min("at").alias("__first"))
    feed = settle(feed.join(origin, "key").select("*", F.floor((F.col("at") - F.col("__first")) / width).cast("bigint").alias("fine")))

    def replay(scale: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows of side 0 are what was accepted before. Gives refused rows (side 2) and what is left at the end of a cell (side 0, of the next cell)."""
            at_cell, quota, last = None, None, None

            def left() -> pd.DataFrame:
                end = last["first"] + (last["cell"] + 1) * width * scale
                rows = [(last["key"], last["cell"] + 1, last["owner"], t, 0, last["tie"], u) for t, u in quota.taken if t > end - window_us]
                return pd.DataFrame(rows, columns=fields)

            for b in batches:
                if not len(b):
                    continue
                change = np.flatnonzero((b["key"].to_numpy()[1:] != b["key"].to_numpy()[:-1]) | (b["cell"].to_numpy()[1:] != b["cell"].to_numpy()[:-1])) + 1
                for lo, hi in zip([0, *change], [*change, len(b)]):
                    piece = b.iloc[lo:hi]
                    if (piece["key"].iloc[0], piece["cell"].iloc[0]) != at_cell:
                        if at_cell is not None:
                            yield left()
                        at_cell, quota = (piece["key"].iloc[0], piece["cell"].iloc[0]), Quota(window_us, max_units)
                    last = {n: piece[n].iloc[-1] for n in ("key", "cell", "owner", "first", "tie")}
                    before = piece["side"].to_numpy() == 0
                    quota.take(piece["at"].to_numpy()[before], piece["units"].to_numpy()[before])
                    rest = piece[~before]
                    refused = rest[~quota.admit(rest["at"].to_numpy(), rest["units"].to_numpy())]
                    yield refused.assign(side=2)[fields]
            if at_cell is not None:
                yield left()

        return run

    def run(active: DataFrame | None, starts: DataFrame | None, scale: int) -> DataFrame:
        """The replay of the active cells (all) from their starts (empty)."""
        rows = feed.select("key", F.floor(F.col("fine") / scale).cast("bigint").alias("cell"), "owner", F.col("__first").alias("first"), "at", "side", "tie", "units")
        if active is not None:
            before = starts.join(origin, "key").select("key", "cell", "owner", F.col("__first").alias("first"), "at", "side", "tie", "units")
            # settled, so that the union has no partitioning of its own: of two sides dealt alike Spark would leave out the repartition, though it coalesces each by itself
            rows = rows.join(active, ["key", "cell"], "left_semi").unionByName(settle(before.join(active, ["key", "cell"], "left_semi")))
        laid = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "at", "side", "tie")
        return settle(laid.mapInPandas(replay(scale), out_schema))

    def digest(starts: DataFrame, name: str) -> DataFrame:
        return starts.groupBy("key", "cell").agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("at", "units").cast("decimal(38,0)")).alias("h")).alias(name))

    def cells(scale: int) -> DataFrame:
        return feed.select("key", F.floor(F.col("fine") / scale).cast("bigint").alias("cell")).distinct()

    scale, rounds = 1, 0
    result = run(None, None, scale)
    used = result.where("side = 0").limit(0)
    while True:
        starts = result.where("side = 0").join(cells(scale), ["key", "cell"], "left_semi")
        changed = digest(starts, "now").join(digest(used, "then"), ["key", "cell"], "full_outer").where("NOT (now <=> then)").select("key", "cell")
        changed = settle(changed)
        if changed.isEmpty():
            return result.where("side = 2").select("owner", "at", "tie")
        rounds += 1
        if rounds % patience == 0:
            # a wide cell starts as its first half did; it has run if its second half ran from what the first half left
            scale *= 2
            half = lambda df: df.withColumn("cell", F.floor(F.col("cell") / 2).cast("bigint"))
            used = used.where("cell % 2 = 0")
            result = result.where("side = 2 OR cell % 2 = 0")
            changed, used = half(changed).distinct(), half(used)
            result = result.withColumn("cell", F.floor(F.col("cell") / 2).cast("bigint"))
            starts = half(starts.where("cell % 2 = 0"))
        again = run(changed, starts, scale)
        follows = F.when(F.col("side") == 0, F.col("cell") - 1).otherwise(F.col("cell"))
        kept = result.withColumn("__by", follows).join(changed.withColumnRenamed("cell", "__by"), ["key", "__by"], "left_anti").drop("__by")
        result = settle(kept.select(fields).unionByName(again.select(fields)))
        used = settle(starts)


# ------------------------------------------------------------------ idempotence


def first_per_idempotency_key(df: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    """Every request with the id that answers it: the first row of its key."""
    first = df.groupBy(*key).agg(F.min_by(F.col(tie), F.struct(F.col(at), F.col(tie))).alias("answered_by"))
    return df.join(first, key)


def latest_per_tenant(events: DataFrame, n: int, at: str = "ts", tie: str = "event_id", key: str = "user_id") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.col(at).desc(), F.col(tie).desc()))
    return events.withColumn("rank", rank).where(F.col("rank") <= n)


def affected_by_outage(calls: DataFrame, outages: DataFrame, max_seconds: int = V.OUTAGE_MAX_SECONDS) -> DataFrame:
    """Calls whose tenant had a running outage window at call time (windows are capped at ``max_seconds``).

    The interval join is an equi join on (owner, coarse time slot): a window
    covers at most two slots, a call falls in one.
    """
    slot_us = max_seconds * 1_000_000
    length = F.least(F.lit(max_seconds), F.greatest(F.lit(1), F.col("seconds"))).cast("bigint") * 1_000_000
    windows = outages.select("owner_id", micros("enabled_at").alias("__lo"), (micros("enabled_at") + length).alias("__hi"))
    slot = lambda c: F.floor(c / slot_us).cast("bigint")
    windows = windows.select("owner_id", "__lo", "__hi", F.explode(F.sequence(slot(F.col("__lo")), slot(F.col("__hi")))).alias("__slot"))
    at = micros("started_at")
    keyed = calls.withColumns({"__at": at, "__slot": slot(at)})
    same = (keyed["owner_id"] == windows["owner_id"]) & (keyed["__slot"] == windows["__slot"]) & (keyed["__at"] >= windows["__lo"]) & (keyed["__at"] <= windows["__hi"])
    return keyed.join(windows, same, "left_semi").drop("__at", "__slot")
