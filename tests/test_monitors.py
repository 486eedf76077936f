"""Folds against brute force, with one hot key, and batch against stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from callgrain.operators import monitors as M
from callgrain.operators.intervals import match_events, span_features
from callgrain.streaming import ingest, source, stateful


def hot_rows(n=3000, seed=5, step=40):
    rng = random.Random(seed)
    t, out = 1_000_000, []
    for i in range(n):
        t += rng.choice([1, 3, step, step * 5, step * 200 if i % 97 == 0 else 2])
        out.append((i, "hot" if i % 3 else f"k{i % 7}", t * 1_000_000, 1 + i % 4))
    return out


def spacing(rows, gap):
    kept, last = set(), {}
    for _, k, t, _ in sorted(rows, key=lambda r: r[2]):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            kept.add((k, t))
    return kept


def admission(rows, window, limit):
    taken, refused = {}, set()
    for i, k, t, u in sorted(rows, key=lambda r: (r[2], r[0])):
        mine = taken.setdefault(k, [])
        used = sum(x for at, x in mine if t - at < window)
        if used + u <= limit:
            mine.append((t, u))
        else:
            refused.add(i)
    return refused


@pytest.mark.parametrize("gap_s, spans", [(10, 4), (60, 96), (900, 8), (7, 2)])
def test_greedy_spacing_equals_replay(spark, gap_s, spans):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id long, k string, at long, u long")
    got = {(r.k, r.at) for r in M.greedy_spacing(df, key="k", at="at", gap_us=gap_s * 1_000_000, spans=spans).collect()}
    assert got == spacing(rows, gap_s * 1_000_000)


def test_greedy_spacing_on_a_perfectly_regular_key(spark):
    rows = [(i, "only", i * 1_000_000, 1) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, k string, at long, u long")
    got = {(r.k, r.at) for r in M.greedy_spacing(df, key="k", at="at", gap_us=17_000_000, spans=5).collect()}
    assert got == spacing(rows, 17_000_000)


def test_exit_steps_describe_every_entry():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = np.unique(rng.integers(1000, 1400, size=rng.integers(1, 60)))
        until, ex = M.exit_steps(t, 1000, 37)
        for e in range(900, 1037):
            kept = M.kept_in_span(t, e, 37)
            i = int(np.searchsorted(until, e, side="left"))
            assert (kept[-1] if len(kept) else None) == (ex[i] if i < len(until) else None)


@pytest.mark.parametrize("window_s, limit", [(60, 10), (600, 40), (5, 3), (3600, 60)])
def test_quota_replay_equals_sequential(spark, window_s, limit):
    rows = hot_rows(seed=9)
    df = spark.createDataFrame(rows, "id long, k string, at long, u long")
    out = M.quota_replay(df, key="k", at="at", tie="id", units="u", window_us=window_s * 1_000_000, max_units=limit)
    got = {r.id for r in out.where("NOT accepted").collect()}
    assert got == admission(rows, window_s * 1_000_000, limit)
    assert out.count() == len(rows)


@pytest.mark.parametrize(("step", "cell_windows", "patience"), [([1, 2, 3, 7], 4, 3), ([5], 1, 2), ([5], 2, 1)])
def test_a_key_over_its_limit_for_its_whole_life(spark, step, cell_windows, patience):
    # irregular requests, whose cells forget where they started, and requests as regular as a clock, whose cells never do
    rng, t, rows = random.Random(3), 0, []
    for i in range(4000):
        t += rng.choice(step) * 1_000_000
        rows.append((i, "only", t, 1 + (i % 3 if len(step) > 1 else 0)))
    df = spark.createDataFrame(rows, "id long, k string, at long, u long")
    out = M.quota_replay(df, key="k", at="at", tie="id", units="u", window_us=300_000_000, max_units=20, cell_windows=cell_windows, patience=patience)
    assert {r.id for r in out.where("NOT accepted").collect()} == admission(rows, 300_000_000, 20)


def test_trailing_counts_open_lower_end(spark):
    rows = hot_rows(800)
    df = spark.createDataFrame(rows, "id long, k string, at long, u long")
    w = 120 * 1_000_000
    got = {r.id: r.n for r in M.trailing(df, key="k", at="at", window_us=w, counters={"n": F.lit(1)}).collect()}
    want = {i: sum(1 for _, k2, t2, _ in rows if k2 == k and t - w < t2 <= t) for i, k, t, _ in rows}
    assert got == want


def test_sla_needs_five_calls_and_a_strictly_higher_rate(spark):
    rows = [(1, f"2024-01-01 10:0{i}:00", "failed" if i < f else "completed") for f, i in [(1, i) for i in range(4)]]
    rows += [(2, f"2024-01-01 10:0{i}:00", "failed" if i < 1 else "completed") for i in range(5)]
    rows += [(3, f"2024-01-01 10:{i:02d}:00", "failed" if i < 1 else "completed") for i in range(20)]
    calls = spark.createDataFrame(rows, "owner_id int, t string, status string").selectExpr("owner_id", "to_timestamp(t) AS started_at", "status")
    empty = spark.createDataFrame([], "owner_id int, max_failure_rate_pct double, window_minutes int")
    got = {r.owner_id: (r.total, r.breached) for r in M.sla_status(calls, empty, F.expr("timestamp'2024-01-01 10:30:00'")).collect()}
    assert got == {1: (4, False), 2: (5, True), 3: (20, False)}


def test_event_matching_is_one_to_one_and_first_fit(spark):
    rng = random.Random(2)
    truth, det = [], []
    for k in range(6):
        base = 0
        for _ in range(60):
            base += rng.choice([200, 900, 4000, 2500])
            truth.append((k, base, rng.choice("ab")))
        base = 0
        for _ in range(70):
            base += rng.choice([300, 800, 3000, 1700])
            det.append((k, base, rng.choice("ab")))
    tol = 1500
    want = set()
    for k in range(6):
        ts, ds = sorted(t[1:] for t in truth if t[0] == k), sorted(d[1:] for d in det if d[0] == k)
        used = set()
        for at, kind in ts:
            j = next((j for j, d in enumerate(ds) if j not in used and abs(d[0] - at) <= tol), None)
            if j is not None:
                used.add(j)
            want.add((k, at, kind, j is not None, j is not None and ds[j][1] == kind))
    schema = "call_id int, at long, kind string"
    out = match_events(spark.createDataFrame(truth, schema), spark.createDataFrame(det, schema), key="call_id", tolerance=tol, span=20_000)
    got = {(r.call_id, r.at, r.kind, r.matched, r.kind_right) for r in out.where("side = 'truth'").collect()}
    assert got == want


def first_fit(truth, det, tol):
    """(key, at, kind, matched, kind_right) of each truth event, and (key, at, kind) of each detection used."""
    want, taken = [], []
    for k in {t[0] for t in truth}:
        ts, ds = sorted(t[1:] for t in truth if t[0] == k), sorted(d[1:] for d in det if d[0] == k)
        used = set()
        for at, kind in ts:
            j = next((j for j, d in enumerate(ds) if j not in used and abs(d[0] - at) <= tol), None)
            if j is not None:
                used.add(j)
                taken.append((k, *ds[j]))
            want.append((k, at, kind, j is not None, j is not None and ds[j][1] == kind))
    return sorted(want), sorted(taken)


@pytest.mark.parametrize("found_step, span", [(7, 3_000), (10, 4_000), (13, 10**9)])
def test_a_dense_key_is_matched_over_cells(spark, found_step, span):
    # no gap anywhere: more detections than events, as many in lockstep with a lag that never ends, and fewer; ties too
    truth = [("hot", 500 + 10 * i, "ab"[i % 2]) for i in range(1500)] + [("hot", 3000, "a")] * 3 + [("cold", 10, "a")]
    det = [("hot", found_step * i, "abc"[i % 3]) for i in range(1500)] + [("hot", 3010, "b")] * 2
    schema, tol = "k string, at long, kind string", 60
    out = match_events(spark.createDataFrame(truth, schema), spark.createDataFrame(det, schema), key="k", tolerance=tol, span=span).collect()
    want, used = first_fit(truth, det, tol)
    assert sorted((r.k, r.at, r.kind, r.matched, r.kind_right) for r in out if r.side == "truth") == want
    assert sorted((r.k, r.at, r.kind) for r in out if r.side == "detected") == sorted(det)
    assert sorted((r.k, r.at, r.kind) for r in out if r.side == "detected" and r.matched) == used


def test_matching_without_events_or_detections(spark):
    schema = "k string, at long, kind string"
    none, one = spark.createDataFrame([], schema), spark.createDataFrame([("a", 5, "x")], schema)
    assert match_events(none, none, key="k", tolerance=1, span=10).count() == 0
    assert [(r.side, r.matched) for r in match_events(one, none, key="k", tolerance=1, span=10).collect()] == [("truth", False)]
    assert [(r.side, r.matched) for r in match_events(none, one, key="k", tolerance=1, span=10).collect()] == [("detected", False)]


def _stream_of(spark, rows, folder, shuffled):
    """Writes the rows as several files, in time order or slightly shuffled, and reads them one file per batch."""
    rows = sorted(rows, key=lambda r: r[2])
    if shuffled:
        rng = random.Random(4)
        rows = [r for _, r in sorted(enumerate(rows), key=lambda x: x[0] + rng.uniform(0, 40))]
    size = len(rows) // 6 + 1
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i:i + size], "id long, k string, at long, u long").selectExpr(
            "id", "k", "timestamp_micros(at) AS ts", "u").coalesce(1).write.mode("append").parquet(folder)
    return source.event_stream(spark, folder, "id BIGINT, k STRING, ts TIMESTAMP, u BIGINT", files_per_trigger=1)


@pytest.mark.parametrize("shuffled", [False, True])
def test_stream_equals_batch(spark, tmp_path, shuffled):
    rows = hot_rows(500, seed=11, step=30)
    end = max(r[2] for r in rows)
    delay = 30 * 24 * 3600  # long enough that nothing is late
    rows.append((10_000, "closing", end + (delay + 10) * 1_000_000, 1))
    stream = _stream_of(spark, rows, str(tmp_path / f"in{shuffled}"), shuffled)
    kept = source.run_to_table(stateful.spaced(stream, key="k", at="ts", tie="id", gap_us=60_000_000, delay=f"{delay} seconds"), "t")
    assert {(r.key, r.at_us) for r in kept.collect()} == spacing(rows[:-1], 60_000_000)
    out = source.run_to_table(stateful.admitted(stream, key="k", at="ts", tie="id", units="u", window_us=600_000_000, max_units=20, delay=f"{delay} seconds"), "t")
    assert {r.tie for r in out.where("NOT accepted").collect()} == admission(rows[:-1], 600_000_000, 20)


@pytest.mark.parametrize("shuffled", [False, True])
def test_streamed_rates_equal_those_at_every_call(spark, tmp_path, shuffled):
    """Several batches, one hot tenant, ties, own windows; then a quiet year, after which the state is empty and fills again."""
    rng = random.Random(8)
    rows, t = [], 1_700_000_000
    for i in range(900):
        t += rng.choice([0, 1, 5, 90]) if i != 600 else 366 * 86_400
        rows.append((i, 7 if i % 3 else i % 5, t * 1_000_000, rng.choice(["failed", "completed", "completed", "in_progress"])))
    make = lambda r: spark.createDataFrame(r, "id long, owner_id long, at long, status string").selectExpr("id", "owner_id", "timestamp_micros(at) AS started_at", "status")
    own = spark.createDataFrame([(7, 20), (2, 300)], "owner_id long, window_minutes int")
    want = {tuple(r) for r in M.failure_rate_at_every_call(make(rows), 30 * M.MINUTE, own).select("id", "owner_id", "at_us", "total", "failed").collect()}
    delay = 3600 if shuffled else 0
    closing = [(10_000, 99, (t + delay + 10) * 1_000_000, "completed")]
    parts = sorted(rows, key=lambda r: r[2] + (rng.uniform(0, 1.8e9) if shuffled else 0))
    folder = str(tmp_path / "in")
    for part in [*(parts[k : k + 150] for k in range(0, 900, 150)), closing]:
        make(part).coalesce(1).write.mode("append").parquet(folder)
    stream = source.event_stream(spark, folder, "id BIGINT, owner_id BIGINT, started_at TIMESTAMP, status STRING", files_per_trigger=1)
    out = source.run_to_table(stateful.trailing_rates(stream, own, window_us=30 * M.MINUTE, delay=f"{delay} seconds"), "rates")
    assert {tuple(r) for r in out.select("id", "owner_id", "at_us", "total", "failed").collect() if r.id != 10_000} == want


def test_late_rows_are_dropped(spark, tmp_path):
    base = 1_700_000_000
    first = [(1, "a", base * 1_000_000, 1), (2, "a", (base + 7200) * 1_000_000, 1)]
    late = [(3, "a", (base + 60) * 1_000_000, 1), (4, "a", (base + 20_000) * 1_000_000, 1)]
    folder = str(tmp_path / "late")
    import time

    for part in (first, late, [(5, "z", (base + 90_000) * 1_000_000, 1)]):
        spark.createDataFrame(part, "id long, k string, at long, u long").selectExpr("id", "k", "timestamp_micros(at) AS ts", "u").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    stream = source.event_stream(spark, folder, "id BIGINT, k STRING, ts TIMESTAMP, u BIGINT", files_per_trigger=1)
    out = source.run_to_table(stateful.spaced(stream, key="k", at="ts", tie="id", gap_us=1, delay="10 minutes"), "late")
    assert sorted(r.tie for r in out.collect()) == [1, 2, 4]


def call_events():
    """(call_id, owner_id, seconds, type, stage, status): completed, aborted, and completed after the limit."""
    rows = []
    for c in range(30):
        t = 10_000 + 100 * c
        rows += [(c, c % 3 or None, t, "started", None, None), (c, None, t + 5, "stage", "stt", "ok"), (c, None, t + 9, "stage", "llm", "timeout" if c % 4 == 0 else "ok")]
        if c % 5 != 2:
            rows.append((c, None, t + (20 if c % 7 else 900), "completed", None, "failed" if c % 4 == 0 else "completed"))
            rows.append((c, None, t + 30, "stage", "tts", "ok"))  # after the completion: not part of the call
    return rows + [(99, None, 19_000, "started", None, None)]


@pytest.mark.parametrize(("key", "batches"), [("int", "one"), ("string", "three"), ("bigint", "shuffled")])
def test_calls_are_assembled_alike_under_any_batches(spark, tmp_path, key, batches):
    rows, limit = call_events(), 300
    want = []
    for c in range(30):
        own = [r for r in rows if r[0] == c]
        done = [r for r in own if r[3] == "completed" and r[2] - own[0][2] <= limit]
        end = done[0][2] if done else own[0][2] + limit
        stages = ",".join(f"{r[4]}:{r[5]}" for r in sorted(own, key=lambda r: r[2]) if r[3] == "stage" and r[2] <= end)
        want.append((str(c), own[0][1], own[0][2] * 10**6, end * 10**6, done[0][5] if done else "aborted", stages))
    schema = f"call_id {key}, owner_id long, ts timestamp, type string, stage string, status string"
    made = spark.createDataFrame(rows, "call_id long, owner_id long, s long, type string, stage string, status string").selectExpr(
        f"CAST(call_id AS {key}) AS call_id", "owner_id", "timestamp_seconds(s) AS ts", "type", "stage", "status")
    parts = {"one": ["true"], "three": ["unix_seconds(ts) < 11000", "unix_seconds(ts) BETWEEN 11000 AND 11999", "unix_seconds(ts) >= 12000"], "shuffled": [*(f"call_id < 99 AND pmod(xxhash64(ts, type), 4) = {k}" for k in range(4)), "call_id = 99"]}[batches]
    folder = str(tmp_path / "in")
    for k, part in enumerate(parts):
        made.where(part).coalesce(1).write.mode("append").parquet(folder)
    stream = source.event_stream(spark, folder, schema, files_per_trigger=1)
    # a delay longer than the disorder of the files, so that no row is late
    got = source.run_to_table(stateful.assembled_calls(stream, timeout_ms=limit * 1000, delay="2 hours" if batches == "shuffled" else "10 minutes"), "assembly").collect()
    got = sorted((str(r.call_id), r.owner_id, r.started_us, r.ended_us, r.status, r.stages) for r in got)
    passed = 19_000 - (7200 if batches == "shuffled" else 600)
    assert got == sorted(w for w in want if w[3] < passed * 10**6)


def test_rows_for_a_closed_call_are_dropped(spark, tmp_path):
    schema = "call_id int, owner_id long, ts timestamp, type string, stage string, status string"
    batches = [[(1, 0, "started"), (1, 10, "completed"), (2, 1000, "started")], [(1, 500, "stage"), (2, 1010, "completed"), (3, 3000, "started")], [(1, 5, "stage"), (2, 2500, "stage"), (4, 9000, "started")]]
    folder = str(tmp_path / "in")
    for rows in batches:
        df = spark.createDataFrame(rows, "call_id int, s long, type string").selectExpr("call_id", "CAST(NULL AS long) AS owner_id", "timestamp_seconds(s) AS ts", "type", "CAST(NULL AS string) AS stage", "type AS status")
        df.coalesce(1).write.mode("append").parquet(folder)
    stream = source.event_stream(spark, folder, schema, files_per_trigger=1)
    got = source.run_to_table(stateful.assembled_calls(stream, timeout_ms=3_600_000), "closed").collect()
    assert sorted((r.call_id, r.status, r.stages) for r in got) == [(1, "completed", ""), (2, "completed", ""), (3, "aborted", "")]


def test_the_first_request_wins_whatever_comes_again(spark, tmp_path):
    folder, schema = str(tmp_path / "accepted"), "owner_id string, k int, id int, ts int, note string"
    batches = [[("a", 1, 5, 50, "x"), ("a", 1, 4, 50, "y"), ("a", 2, 6, 10, None), (None, 1, 7, 1, "null owner")], [("a", 1, 1, 0, "late"), ("b", 1, 8, 3, "z"), (None, 1, 9, 2, "again")], []]
    once = ingest.first_wins(folder, ["owner_id", "k"], buckets=3)
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    for k in (0, 1, 1, 2, 0):  # batches run again after a failure give the same
        once(frames[k], k)
    accepted = spark.read.parquet(folder)
    assert sorted((r.owner_id or "", r.k, r.id) for r in accepted.collect()) == [("", 1, 7), ("a", 1, 4), ("a", 2, 6), ("b", 1, 8)]
    every = frames[0].unionByName(frames[1])
    assert {r.id: r.answered_by for r in ingest.answered(every, accepted, ["owner_id", "k"]).collect()} == {5: 4, 4: 4, 1: 4, 6: 6, 7: 7, 9: 7, 8: 8}


class _Held:
    """State variables of one key in memory, counting what is written."""

    def __init__(self):
        self.held, self.writes = {}, 0

    def exists(self):
        return bool(self.held)

    def get(self):
        return self.held.get("all", ())

    def update(self, value):
        self.held["all"] = value

    put = update

    def clear(self):
        self.held.clear()

    def updateValue(self, key, value):
        self.held[key] = value
        self.writes += 1

    def getValue(self, key):
        return self.held[key]

    def removeKey(self, key):
        del self.held[key]

    def keys(self):
        return list(self.held)

    def iterator(self):
        return list(self.held.items())


def test_trailing_counts_write_only_cells_that_are_asked_for_again():
    import numpy as np
    import pandas as pd

    monitor = stateful.TrailingCounts(cells=4)
    monitor.pending, monitor.setting, monitor.counts, monitor.rows = (_Held() for _ in range(4))
    monitor.handle = type("Handle", (), {"registerTimer": lambda self, ms: None})()
    at = np.sort(np.random.default_rng(5).integers(0, 500_000_000, 400))
    frame = pd.DataFrame({"at_us": at, "tie": np.arange(400), "failed": np.arange(400) % 3 == 0, "window_us": 8_000_000})
    clock = type("Clock", (), {"now": 0, "getCurrentWatermarkInMs": lambda self: self.now})()
    assert not list(monitor.handleInputRows((1,), iter([frame]), clock))
    got = []
    for clock.now in (400_000, 600_000):
        got += [b for b in monitor.handleExpiredTimer((1,), clock, None)]
    got = pd.concat(got)
    want = [int(((at > t - 8_000_000) & (at <= t)).sum()) for t in at]
    bad = [int((frame.failed & (at > t - 8_000_000) & (at <= t)).sum()) for t in at]
    assert got.total.tolist() == want and got.failed.tolist() == bad
    assert monitor.counts.writes <= 5 and monitor.rows.writes <= 5  # 4 cells in a window and the open one; all were written before
    assert not monitor.counts.held and not monitor.setting.held


def test_span_features_sort_each_list_once(spark):
    frames = spark.createDataFrame([(1, i, float((i * 7) % 11 + 100), -20.0 - i, -70.0) for i in range(11)], "call_id BIGINT, frame_idx BIGINT, f0 DOUBLE, db DOUBLE, floor_db DOUBLE")
    spans = spark.createDataFrame([(1, 1, 0, 550), (1, 2, 5000, 5100)], "call_id BIGINT, phrase_id BIGINT, start_ms BIGINT, end_ms BIGINT")
    out = span_features(frames, spans, span_key=["call_id", "phrase_id"], hop_ms=50)
    got = {r.phrase_id: (r.frames, r.f0_median, r.f0_p10, r.f0_p90, r.level_db) for r in out.collect()}
    assert got == {1: (11, 105.0, 101.0, 109.0, -25.0), 2: (0, None, None, None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort(" not in plan and plan.count("sort_array(") == 2


def test_keys_of_a_bucket_share_state_and_timers():
    import pandas as pd

    rows = hot_rows(600, seed=3, step=30)
    want = spacing(rows, 60_000_000)
    names = sorted({r[1] for r in rows})
    frame = pd.DataFrame([(k, t, i, 0) for i, k, t, _ in rows], columns=["key", "at_us", "tie", "units"])
    second = stateful.Spacing(60_000_000)
    first = stateful.Packed(second.thin)
    pieces, timers = [], []
    first.pending = type("Pieces", (), {"appendValue": lambda self, v: pieces.append(v), "exists": lambda self: bool(pieces), "get": lambda self: list(pieces), "put": lambda self, v: pieces.__setitem__(slice(None), v), "clear": lambda self: pieces.clear()})()
    first.handle = type("Handle", (), {"registerTimer": lambda self, ms: timers.append(ms)})()
    second.kept = _Held()
    clock = type("Clock", (), {"now": 0, "getCurrentWatermarkInMs": lambda self: self.now})()
    assert not list(first.handleInputRows((0, 0), iter([frame]), clock))
    assert len(names) > 1 and len(pieces) == len(timers) == 1  # one call each for all keys
    got = set()
    times = sorted(r[2] for r in rows)
    for clock.now in (times[300] // 1000, times[-1] // 1000 + 1, times[-1] // 1000 + 61_000):
        for out in first.handleExpiredTimer((0, 0), clock, None):
            for b in second.handleInputRows((0,), iter([out]), clock):
                got |= {(k, t) for k, t in zip(b["key"], b["at_us"])}
    assert got == want and not pieces


def test_streams_keep_null_keys_and_large_numbers_apart(spark, tmp_path):
    big = 2**53
    base = 1_700_000_000
    rows = [(i, [None, big, big + 1][i % 3], (base + 20 * i) * 1_000_000) for i in range(90)]
    make = lambda r: spark.createDataFrame(r, "id long, k long, at long").selectExpr("id", "k", "timestamp_micros(at) AS ts")
    folder = str(tmp_path / "in")
    for part in (rows[:40], rows[40:], [(1000, 1, (base + 10_000) * 1_000_000)]):
        make(part).coalesce(1).write.mode("append").parquet(folder)
    stream = source.event_stream(spark, folder, "id BIGINT, k BIGINT, ts TIMESTAMP", files_per_trigger=1)
    kept = source.run_to_table(stateful.spaced(stream, key="k", at="ts", tie="id", gap_us=100_000_000, delay="0 seconds", buckets=1), "t")
    assert {(r.key, r.at_us) for r in kept.collect() if r.key != 1} == spacing([(i, k, t, 0) for i, k, t in rows], 100_000_000)


def test_calls_of_a_bucket_share_state_and_one_timer():
    import pandas as pd

    rows = [(1, c, 1_000_000 * (c + k + 1), kind, c, c % 2 == 0, stage, "ok") for c in range(60) for k, (kind, stage) in enumerate([("started", None), ("stage", "stt"), ("completed", None)])]
    frame = pd.DataFrame(rows, columns=["bucket", "key", "at_us", "type", "owner_id", "owned", "stage", "status"])
    packed = pd.concat(stateful._dealt_and_packed(iter([frame.iloc[:100], frame.iloc[100:]])))
    assert len(packed) == 1  # state is fed with pieces, not with events
    monitor = stateful.Assembly(timeout_ms=5000)
    pieces, timers = [], []
    monitor.events = type("Pieces", (), {"appendValue": lambda self, v: pieces.append(v), "exists": lambda self: bool(pieces), "get": lambda self: list(pieces), "put": lambda self, v: pieces.__setitem__(slice(None), v), "clear": lambda self: pieces.clear()})()
    monitor.closed, monitor.timer = _Held(), _Held()
    monitor.handle = type("Handle", (), {"registerTimer": lambda self, ms: timers.append(ms), "deleteTimer": lambda self, ms: timers.remove(ms)})()
    clock = type("Clock", (), {"now": 0, "getCurrentWatermarkInMs": lambda self: self.now})()
    assert not list(monitor.handleInputRows((1,), iter([packed]), clock))
    assert len(pieces) == 1 and timers == [3000]
    got = []
    for clock.now in (30_500, 70_000, 200_000):
        timers.clear()  # the one that comes
        got += [b for b in monitor.handleExpiredTimer((1,), clock, None)]
        assert len(timers) == (clock.now < 200_000)
    assert [len(b) for b in got] == [28, 32] and not pieces and not monitor.closed.held
    got = pd.concat(got).sort_values("key")
    assert got.stages.tolist() == ["stt:ok"] * 60 and got.ended_us.tolist() == [1_000_000 * (c + 3) for c in range(60)]
    assert [None if pd.isna(v) else v for v in got.owner_id] == [None if c % 2 else c for c in range(60)]


def test_assembly_keeps_nulls_and_large_numbers_apart(spark, tmp_path):
    big = 2**53
    rows = [
        (None, None, 10, "started", None, None), (None, big + 1, 11, "stage", None, None), (None, 7, 11, "stage", "llm", "ok"), (None, None, 12, "completed", None, None),
        (big, big, 10, "started", None, None), (big, None, 13, "completed", None, "failed"), (big, None, 13, "completed", None, "completed"), (big, 1, 14, "stage", "tts", "ok"),
        (big + 1, None, 20, "started", None, None), (big + 1, None, 20, None, "stt", "ok"), (big + 1, None, 320, "completed", None, "completed"),
        (5, 3, 100, "stage", "tts", None), (5, 2, 100, "stage", "stt", "ok"), (5, 1, 401, "completed", None, "completed"), (9, 1, 9000, "started", None, None)]
    schema = "call_id long, owner_id long, s long, type string, stage string, status string"
    folder = str(tmp_path / "in")
    spark.createDataFrame([*rows, (4, 1, None, "started", None, None)], schema).selectExpr("call_id", "owner_id", "timestamp_seconds(s) AS ts", "type", "stage", "status").coalesce(1).write.parquet(folder)
    stream = source.event_stream(spark, folder, "call_id BIGINT, owner_id BIGINT, ts TIMESTAMP, type STRING, stage STRING, status STRING")
    got = source.run_to_table(stateful.assembled_calls(stream, timeout_ms=300_000, buckets=1), "nulls").collect()
    assert {(r.call_id, r.owner_id, r.started_us // 10**6, r.ended_us // 10**6, r.status, r.stages) for r in got} == {
        (None, 7, 10, 12, None, "llm:ok,None:None"), (big, big, 10, 13, "completed", ""), (big + 1, None, 20, 320, "completed", ""), (5, 2, 100, 400, "aborted", "stt:ok,tts:None")}
