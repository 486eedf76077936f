"""Exact per-key monitors with state: cooldown, debounce, quota admission, trailing rates, call assembly.

Rows wait in state until the watermark has passed them and are then replayed
in event-time order, so the result does not depend on how the stream was cut
into batches; rows that arrive behind the watermark are dropped. State holds the
rows younger than the watermark plus one window, and timers remove it. Cooldown and
admission hold rows by (bucket of keys, time cell) and chain the cells of a key in a second step.
"""

from __future__ import annotations

import pickle

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DataType, DateType, DoubleType, FloatType, IntegerType, IntegralType, LongType, NumericType, ShortType, StringType, StructField, StructType, TimestampType

from callgrain import vocab as V
from callgrain.functions import predicates as P
from callgrain.operators.monitors import Quota
from callgrain.streaming.source import WATERMARK

MICROS = 1_000_000


TYPES = {
    "BIGINT": LongType(), "LONG": LongType(), "INT": IntegerType(), "SMALLINT": ShortType(), "STRING": StringType(), "BOOLEAN": BooleanType(),
    "DOUBLE": DoubleType(), "FLOAT": FloatType(), "DATE": DateType(), "TIMESTAMP": TimestampType(),
}


def _schema(text: str, **given: DataType) -> StructType:
    """State and output schemas, spelled out because workers have no session to parse DDL; ``given`` types need no name."""
    pairs = [field.split() for field in text.split(",")]
    return StructType([StructField(name, given[name] if name in given else TYPES[kind[0].upper()]) for name, *kind in pairs])


def _order(row: tuple) -> tuple:
    """Sorts rows that hold nulls; nulls come first."""
    return tuple((v is not None, 0 if v is None else v) for v in row)


def _plain(v):
    return None if pd.isna(v) else v.item() if hasattr(v, "item") else v


def _runs(cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each different value and where it stands, in order; one sort for all of them."""
    order = np.argsort(cells, kind="stable")
    values, first = np.unique(cells[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]))


#: Keys that share a group of state: each call for state or timers serves all keys of a bucket.
BUCKETS = 1024
_COLUMNS = ("key", "at_us", "tie", "units")
_PACKED = StructType([StructField("rows", BinaryType())])


def _packed(rows: pd.DataFrame, columns: Sequence[str] = _COLUMNS) -> bytes:
    return pickle.dumps([rows[c].to_numpy() for c in columns])


def _unpacked(parts: Iterable[bytes], columns: Sequence[str] = _COLUMNS) -> pd.DataFrame:
    """Packed rows, one after the other."""
    held = [pickle.loads(p) for p in parts]
    return pd.DataFrame({c: np.concatenate(v) for c, v in zip(columns, zip(*held))}) if held else pd.DataFrame({c: np.empty(0, np.int64) for c in columns})


def _by_key(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of each key, in order of time and tie; one sort for all of them."""
    code = pd.factorize(rows["key"], use_na_sentinel=False)[0]
    order = np.lexsort((rows["tie"].to_numpy(), rows["at_us"].to_numpy(), code))
    rows, cuts = rows.iloc[order], np.flatnonzero(np.diff(code[order])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(rows)]):
        yield rows.iloc[lo:hi]


class Packed(StatefulProcessor):
    """First step, for each (bucket of keys, time cell): rows wait in packed pieces until the watermark has passed them, and leave as one packed row.

    Rows at or behind the watermark are late, what they would have changed may be out already: they are dropped. As the cell is
    part of the group, a hot key is held and thinned by many tasks.
    """

    def __init__(self, thin: Callable[[np.ndarray], np.ndarray] | None = None) -> None:
        self.thin = thin

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _PACKED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = pd.concat([b[list(_COLUMNS)] for b in rows], ignore_index=True)
        fresh = fresh.assign(**{c: fresh[c].to_numpy(np.int64) for c in _COLUMNS[1:]})
        fresh = fresh[fresh["at_us"] > passed_us]
        if len(fresh):
            self.pending.appendValue((_packed(fresh),))
            # a later piece may hold an earlier row; a timer that comes for nothing does no harm
            self.handle.registerTimer(int(fresh["at_us"].min()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        rows = _unpacked(r[0] for r in self.pending.get()) if self.pending.exists() else _unpacked(())
        passed = rows["at_us"] <= now_us
        due, later = rows[passed], rows[~passed]
        if not len(due):
            return
        if len(later):
            self.pending.put([(_packed(later),)])
            self.handle.registerTimer(int(later["at_us"].min()) // 1000 + 1)
        else:
            self.pending.clear()
        last = pd.Timestamp(int(due["at_us"].max()), unit="us")
        if self.thin is not None:
            due = pd.concat([mine.iloc[self.thin(mine["at_us"].to_numpy())] if len(mine) > 1 else mine for mine in _by_key(due)])
        yield pd.DataFrame([(key[0], last, _packed(due))], columns=["bucket", "event_at", "rows"])

    def close(self) -> None: ...


class _PerKey(StatefulProcessor):
    """Second step, for each bucket: replays the rows of each key after what the key keeps, which is one value of the bucket's state.

    ``replay`` gives what the rows of a key keep and return; what ``outdated`` says can't matter to rows after the watermark is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", _PACKED)

    def handleInputRows(self, key, rows, timerValues):
        kept = pickle.loads(self.kept.get()[0]) if self.kept.exists() else {}
        out = []
        for mine in _by_key(_unpacked(p for b in rows for p in b["rows"])):
            name = str(mine["key"].iloc[0])
            kept[name], result = self.replay(kept.get(name), mine)
            out.append(result)
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        kept = {name: value for name, value in kept.items() if not self.outdated(value, passed_us)}
        self.kept.update((pickle.dumps(kept),))
        yield pd.concat(out, ignore_index=True)

    def close(self) -> None: ...


class Spacing(_PerKey):
    """Keeps a row only if none of its key was kept in the last ``gap_us`` (breach cooldown, debounce)."""

    def __init__(self, gap_us: int) -> None:
        self.gap_us = gap_us

    def thin(self, t: np.ndarray) -> np.ndarray:
        """Places of the rows that some last kept time before them lets through: those of the first gap, and what may follow each."""
        first = np.flatnonzero(np.append(True, np.diff(t) != 0))
        t = t[first]
        follows = np.searchsorted(t, t + self.gap_us, side="left")
        reached = np.zeros(len(t) + 1, bool)
        reached[: int(np.searchsorted(t, t[0] + self.gap_us, side="left")) + 1] = True
        for i in range(len(t)):
            if reached[i]:
                reached[follows[i]] = True
        return first[reached[:-1]]

    def replay(self, last: int | None, rows: pd.DataFrame) -> tuple[int, pd.DataFrame]:
        at = rows["at_us"].to_numpy()
        i = 0 if last is None else int(np.searchsorted(at, last + self.gap_us, side="left"))
        taken = []
        while i < len(at):
            taken.append(i)
            last = int(at[i])
            i = int(np.searchsorted(at, last + self.gap_us, side="left"))
        return last, rows.iloc[taken][["key", "at_us", "tie"]]

    def outdated(self, last: int, passed_us: int) -> bool:
        return last + self.gap_us <= passed_us


class Admission(_PerKey):
    """Accepts a request when the accepted units of the last window plus its own stay within the limit.

    The work is that of the accepted requests; where nothing fits, those up to the next one that leaves the window are passed over.
    """

    def __init__(self, window_us: int, max_units: int) -> None:
        self.window_us, self.max_units = window_us, max_units

    def replay(self, taken: np.ndarray | None, rows: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
        quota = Quota(self.window_us, self.max_units)
        if taken is not None:
            quota.take(*taken)
        accepted = quota.admit(rows["at_us"].to_numpy(), rows["units"].to_numpy())
        return np.array([*quota.taken], np.int64).reshape(-1, 2).T, rows[["key", "at_us", "tie"]].assign(accepted=accepted)

    def outdated(self, taken: np.ndarray, passed_us: int) -> bool:
        return not taken.size or int(taken[0, -1]) + self.window_us <= passed_us


class TrailingCounts(StatefulProcessor):
    """Rows and failed rows in (t - window, t] at each row of a key, once the watermark has passed it.

    State is a ring of time cells, ``cells`` in a window: a counter of each, and its rows. A count is what came up to t
    less what came up to t - window. Each is the counters of whole cells and a look into one cell, so a batch reads the counters
    and the rows of the cells at both ends of its windows, not those between. Cells that no later row can ask for are removed.
    Rows carry the window of their key; one that changes holds from the rows on that carry it, a longer one as far back as rows are kept.
    """

    names = ("key", "at_us", "tie", "total", "failed")
    payload = ("at_us", "tie", "failed", "window_us")

    def __init__(self, cells: int = 64) -> None:
        self.cells = cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        cell = _schema("cell BIGINT")
        self.pending = handle.getListState("pending", _schema("at_us BIGINT, tie BIGINT, failed BIGINT, window_us BIGINT"))
        self.setting = handle.getValueState("setting", _schema("width BIGINT, keep BIGINT"))
        self.counts = handle.getMapState("counts", cell, _schema("total BIGINT, failed BIGINT"))
        self.rows = handle.getMapState("rows", cell, StructType([StructField(n, BinaryType()) for n in ("at_us", "failed")]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [np.stack([b[c].to_numpy(np.int64) for c in self.payload]) for b in rows]
        fresh = np.concatenate(fresh, axis=1)
        yield from self._count(key, fresh[:, fresh[0] > passed_us], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._count(key, np.empty((4, 0), np.int64), timerValues)

    def _count(self, key, fresh: np.ndarray, timerValues) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        held = np.array([tuple(r) for r in self.pending.get()], np.int64).T if self.pending.exists() else np.empty((4, 0), np.int64)
        every = np.concatenate([held, fresh], axis=1)
        every = every[:, np.lexsort((every[1], every[0]))]
        due, later = every[:, every[0] <= now_us], every[:, every[0] > now_us]
        if due.shape[1]:
            yield self._counted(key, due, now_us)
        self._forget(now_us)
        if later.shape[1]:
            self.pending.put([tuple(r) for r in later.T.tolist()])
            self.handle.registerTimer(int(later[0, 0]) // 1000 + 1)
        elif held.shape[1]:
            self.pending.clear()

    def _read(self, cell: int) -> tuple[np.ndarray, np.ndarray]:
        at, failed = self.rows.getValue((cell,))
        return np.frombuffer(at, np.int64), np.frombuffer(failed, np.int64)

    def _counted(self, key, due: np.ndarray, now_us: int) -> pd.DataFrame:
        at, tie, failed, window = due
        width, keep = self.setting.get() if self.setting.exists() else (max(1, int(window[0]) // self.cells), 0)
        keep = max(keep, int(window.max()))
        self.setting.update((width, keep))
        counts = {int(c[0]): tuple(n) for c, n in self.counts.iterator()}
        loaded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c, mine in _runs(at // width):
            old = self._read(c) if c in counts else (np.empty(0, np.int64),) * 2
            loaded[c] = np.concatenate([old[0], at[mine]]), np.concatenate([old[1], failed[mine]])
            counts[c] = len(loaded[c][0]), int(loaded[c][1].sum())
            # each write is a call to the JVM: cells that no later row can ask for are not written, only to be removed again
            if self._needed(c, width, keep, now_us):
                self.counts.updateValue((c,), counts[c])
                self.rows.updateValue((c,), tuple(x.tobytes() for x in loaded[c]))
        cells = np.array(sorted(counts), np.int64)
        before = np.concatenate([[(0, 0)], np.cumsum([counts[c] for c in cells.tolist()], axis=0)])

        def up_to(x: np.ndarray) -> np.ndarray:
            own = x // width
            out = before[np.searchsorted(cells, own)]
            for c, mine in _runs(own):
                if c not in counts:
                    continue
                times, bad = loaded[c] if c in loaded else self._read(c)
                n = np.searchsorted(times, x[mine], side="right")
                out[mine] += np.stack([n, np.append(0, np.cumsum(bad))[n]], axis=1)
            return out

        total = up_to(at) - up_to(at - window)
        return pd.DataFrame({"key": key[0], "at_us": at, "tie": tie, "total": total[:, 0], "failed": total[:, 1]})

    @staticmethod
    def _needed(cell: int, width: int, keep: int, now_us: int) -> bool:
        return (cell + 1) * width > now_us - keep

    def _forget(self, now_us: int) -> None:
        """Removes the cells that end before the window of any row still to come, and looks again when the last one does."""
        if not self.setting.exists():
            return
        width, keep = self.setting.get()
        left = []
        for (c,) in list(self.counts.keys()):
            if self._needed(c, width, keep, now_us):
                left.append(c)
            else:
                self.counts.removeKey((c,))
                self.rows.removeKey((c,))
        if left:
            self.handle.registerTimer(((max(left) + 1) * width + keep) // 1000 + 1)
        else:
            self.setting.clear()

    def close(self) -> None: ...


_EVENT = ("key", "at_us", "type", "owner_id", "owned", "stage", "status")
PACK_ROWS = 1 << 18


def _dealt_and_packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the first step: the events of a task by bucket, packed some ``PACK_ROWS`` at a time. State is fed row by row, so its rows should be few."""

    def pieces(held: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(held, ignore_index=True)
        return pd.DataFrame([(bucket, _packed(rows.iloc[mine], _EVENT)) for bucket, mine in _runs(rows["bucket"].to_numpy())], columns=["bucket", "rows"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= PACK_ROWS:
            yield pieces(held)
            held, n = [], 0
    if n:
        yield pieces(held)


def _ranks(values: pd.Series) -> np.ndarray:
    """Places in sorted order; nulls come first."""
    return pd.factorize(values, sort=True)[0]


class Assembly(StatefulProcessor):
    """Folds the started, stage and completed events of each call into one row; the calls of a bucket share state and one timer.

    Events wait in state until the watermark has passed the first completion of their call, or ``timeout_ms`` of event time
    after its first event, if that comes before; only then the row is written, from the events up to that time, so that it
    doesn't depend on how the stream was cut into batches. A call without a completion by then is aborted. A mark keeps the call
    closed for another ``timeout_ms``; rows for a closed call and rows behind the watermark are dropped. The timer is that of the
    next call or mark that ends.
    """

    names = ("bucket", "key", "owner_id", "started_us", "ended_us", "status", "stages")

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _PACKED)
        self.closed = handle.getValueState("closed", _PACKED)
        self.timer = handle.getValueState("timer", _schema("at_ms BIGINT"))

    def handleInputRows(self, key, rows, timerValues):
        now_ms = timerValues.getCurrentWatermarkInMs()
        fresh = _unpacked((p for b in rows for p in b["rows"]), _EVENT)
        fresh = fresh[fresh["at_us"] > now_ms * 1000]
        if len(fresh) and self.closed.exists():
            fresh = fresh[~fresh["key"].isin(self._marks()["key"])]
        if len(fresh):
            self.events.appendValue((_packed(fresh, _EVENT),))
            self._wake(max(now_ms + 1, -(-int(self._latest_end(fresh).min()) // 1000)))
        return iter(())

    def _marks(self) -> pd.DataFrame:
        """The closed calls and until when they are."""
        return _unpacked([self.closed.get()[0]] if self.closed.exists() else (), ("key", "until_ms"))

    def _wake(self, at_ms: int) -> None:
        """Sees to it that the timer comes by then."""
        if self.timer.exists():
            if (known := self.timer.get()[0]) <= at_ms:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at_ms)
        self.timer.update((at_ms,))

    def _latest_end(self, events: pd.DataFrame) -> np.ndarray:
        """When the call ends at the latest, for all that each event says: the least one of a call is its end."""
        return events["at_us"].to_numpy() + np.where(events["type"].to_numpy() == "completed", 0, self.timeout_ms * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now_ms = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        marks = self._marks()
        marks = marks[marks["until_ms"] >= now_ms]
        events = _unpacked((r[0] for r in self.events.get()) if self.events.exists() else (), _EVENT)
        call, keys = pd.factorize(events["key"], use_na_sentinel=False)
        ends = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(ends, call, self._latest_end(events))
        over = -(-ends // 1000) < now_ms
        if over.any():
            due = over[call]
            yield self._rows(key, events[due], call[due], keys, ends)
            marks = pd.concat([marks, pd.DataFrame({"key": keys[over], "until_ms": now_ms + self.timeout_ms})]) if len(marks) else pd.DataFrame({"key": keys[over], "until_ms": now_ms + self.timeout_ms})
            if due.all():
                self.events.clear()
            else:
                self.events.put([(_packed(events[~due], _EVENT),)])
        if len(marks):
            self.closed.update((_packed(marks, ("key", "until_ms")),))
        else:
            self.closed.clear()
        later = [*(-(-ends[~over] // 1000)), *marks["until_ms"]]
        if later:
            self._wake(int(min(later)))

    def _rows(self, key, events: pd.DataFrame, call: np.ndarray, keys, ends: np.ndarray) -> pd.DataFrame:
        """The row of each call that is over, from its events in order of time, type, owner, stage and status."""
        at, owned, kind, status = events["at_us"].to_numpy(), events["owned"].to_numpy(bool), events["type"].to_numpy(), events["status"].to_numpy()
        owner = np.where(owned, events["owner_id"].to_numpy(), np.iinfo(np.int64).min)
        ranks = _ranks(events["status"])
        order = np.lexsort((ranks, _ranks(events["stage"]), owner, owned, _ranks(events["type"]), at, call))
        order = order[at[order] <= ends[call[order]]]
        mine, firsts = np.unique(call[order], return_index=True)
        started = at[order[firsts]]
        place = np.zeros(len(keys), np.int64)
        place[mine] = np.arange(len(mine))

        def first(rows: np.ndarray, values: np.ndarray, default) -> np.ndarray:
            """The value of the first of these rows of each call."""
            out = np.full(len(mine), default, dtype=object)
            which, at_ = np.unique(call[rows], return_index=True)
            out[place[which]] = values[rows[at_]]
            return out

        done = order[(kind[order] == "completed") & (at[order] == ends[call[order]])]
        done = done[np.lexsort((ranks[done], call[done]))]
        steps = order[kind[order] == "stage"]
        said = (events["stage"].iloc[steps].astype(object).map(str) + ":" + events["status"].iloc[steps].astype(object).map(str)).to_numpy()
        cuts = np.searchsorted(call[steps], mine)
        stages = [",".join(said[lo:hi]) for lo, hi in zip(cuts, [*cuts[1:], len(steps)])]
        return pd.DataFrame({
            "bucket": key[0], "key": keys[mine], "owner_id": first(order[owned[order]], owner, None), "started_us": started, "ended_us": ends[mine],
            "status": first(done, status, "aborted"), "stages": stages})

    def close(self) -> None: ...


def _chained(rows: DataFrame, key: str, at: str, tie: str, units: Column, cell_us: int, delay: str, first: StatefulProcessor, second: StatefulProcessor, out: str, buckets: int) -> DataFrame:
    """Both steps: (bucket of keys, cell of ``cell_us``), then bucket. The watermark of the first holds for what it gives, so the second gets all of a key up to it in one batch."""
    us = F.unix_micros(at)
    kt = rows.schema[key].dataType
    # a null turns the numbers beside it in a batch into floats: numbers go to Python as text, and come back as they were
    held = F.col(key).cast("string") if isinstance(kt, NumericType) else F.col(key)
    bucket = F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("bigint")
    # rows without a time never pass the watermark, and a null cell would turn the others into floats
    marked = rows.where(F.col(at).isNotNull()).withWatermark(at, delay).select(
        bucket.alias("bucket"), F.floor(us / cell_us).cast("bigint").alias("cell"), held.alias("key"), F.col(at).alias("event_at"), us.alias("at_us"), F.col(tie).cast("bigint").alias("tie"),
        units.cast("bigint").alias("units"))
    packed = marked.groupBy("bucket", "cell").transformWithStateInPandas(
        first, StructType([StructField("bucket", LongType()), StructField("event_at", TimestampType()), *_PACKED]), "Append", "EventTime", eventTimeColumnName="event_at")
    replayed = packed.groupBy("bucket").transformWithStateInPandas(second, _schema(f"key, {out}", key=marked.schema["key"].dataType), "Append", "EventTime")
    return replayed.withColumn("key", F.col("key").cast(kt))


def spaced(rows: DataFrame, *, key: str, at: str, tie: str, gap_us: int, delay: str = WATERMARK, spans: int = 8, buckets: int = BUCKETS) -> DataFrame:
    """Streaming twin of ``operators.monitors.greedy_spacing``; a cell holds ``spans`` gaps."""
    second = Spacing(gap_us)
    return _chained(rows, key, at, tie, F.lit(0), spans * gap_us, delay, Packed(second.thin), second, "at_us BIGINT, tie BIGINT", buckets)


def admitted(rows: DataFrame, *, key: str, at: str, tie: str, units: str, window_us: int = 3600 * MICROS, max_units: int = V.HOURLY_UNITS_PER_ADDRESS, delay: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """Streaming twin of ``operators.monitors.quota_replay``; a cell is as long as the window."""
    second = Admission(window_us, max_units)
    return _chained(rows, key, at, tie, F.col(units), window_us, delay, Packed(), second, "at_us BIGINT, tie BIGINT, accepted BOOLEAN", buckets)


def trailing_rates(
    calls: DataFrame, config: DataFrame | None = None, window_us: int = V.SLA_WINDOW_MINUTES * 60 * MICROS, delay: str = WATERMARK, id_: str = "id"
) -> DataFrame:
    """Streaming twin of ``operators.monitors.failure_rate_at_every_call``: (id, owner_id, at_us, total, failed, rate_pct) of finished calls.

    ``config``: a static table (owner_id, window_minutes), joined on its own terms; tenants that aren't in it have ``window_us``.
    """
    rows = calls.where(P.finished()).withWatermark("started_at", delay)
    width = F.lit(window_us).cast("bigint")
    if config is not None:
        rows = rows.join(config.select("owner_id", (F.col("window_minutes").cast("bigint") * 60 * MICROS).alias("own_us")), "owner_id", "left")
        width = F.coalesce("own_us", width)
    keyed = rows.select(
        F.col("owner_id").alias("key"), F.col("started_at").alias("event_at"), F.unix_micros("started_at").alias("at_us"), F.col(id_).cast("bigint").alias("tie"),
        (F.col("status") == "failed").cast("bigint").alias("failed"), width.alias("window_us"))
    out = _schema("key, at_us BIGINT, tie BIGINT, total BIGINT, failed BIGINT", key=keyed.schema["key"].dataType)
    counted = keyed.groupBy("key").transformWithStateInPandas(TrailingCounts(), out, "Append", "EventTime")
    return counted.select(F.col("tie").alias(id_), F.col("key").alias("owner_id"), "at_us", "total", "failed", (F.col("failed") * 100.0 / F.col("total")).alias("rate_pct"))


def assembled_calls(events: DataFrame, timeout_ms: int = 5 * 60_000, delay: str = WATERMARK, buckets: int = BUCKETS) -> DataFrame:
    """Call rows from an event stream (call_id, owner_id, ts, type, stage, status)."""
    kt = events.schema["call_id"].dataType
    bucket = F.when(F.col("call_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("call_id"), F.lit(buckets))).cast("bigint")
    # nulls turn the whole numbers beside them in a batch into floats: they have a bucket or a column to themselves
    held = F.coalesce(F.col("call_id").cast("bigint"), F.lit(0)) if isinstance(kt, IntegralType) else F.col("call_id").cast("string") if isinstance(kt, NumericType) else F.col("call_id")
    # rows without a time never pass the watermark
    marked = events.where(F.col("ts").isNotNull()).withWatermark("ts", delay).select(
        bucket.alias("bucket"), held.alias("key"), F.unix_micros("ts").alias("at_us"), "type", F.coalesce(F.col("owner_id").cast("bigint"), F.lit(0)).alias("owner_id"),
        F.col("owner_id").isNotNull().alias("owned"), "stage", "status")
    packed = marked.mapInPandas(_dealt_and_packed, StructType([StructField("bucket", LongType()), *_PACKED]))
    out = _schema("bucket BIGINT, key, owner_id BIGINT, started_us BIGINT, ended_us BIGINT, status STRING, stages STRING", key=marked.schema["key"].dataType)
    rows = packed.groupBy("bucket").transformWithStateInPandas(Assembly(timeout_ms), out, "Append", "EventTime")
    return rows.select(F.when(F.col("bucket") >= 0, F.col("key").cast(kt)).alias("call_id"), "owner_id", "started_us", "ended_us", "status", "stages")
