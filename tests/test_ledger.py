"""Ledger arithmetic on hand-made rows, sinks, sources and registered names."""

import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from callgrain.functions import redaction, register
from callgrain.operators import calibration as K
from callgrain.operators import compare as A
from callgrain.operators import grounding as G
from callgrain.operators import ledger as L
from callgrain.operators import monitors as M
from callgrain.operators import reports
from callgrain.sources import audio, recogniser, sinks
from callgrain.sources.ledger import load_calls

CALL = "id int, owner_id int, status string, injected_fault string, label_source string, predicted_category string, total_cost_usd double, t string"


def calls(spark, rows):
    return spark.createDataFrame(rows, CALL).withColumn("started_at", F.to_timestamp("t")).drop("t")


def test_calibration_counts_only_known_truth(spark):
    t = "2024-01-01 00:00:00"
    df = calls(spark, [
        (1, 1, "failed", "timeout", None, "timeout", .1, t), (2, 1, "failed", "bad_stt", None, "ok", .1, t), (3, 1, "completed", None, "control", "ok", .1, t),
        (4, 1, "failed", None, None, "timeout", .1, t), (5, 1, "in_progress", "timeout", None, None, .1, t)])
    cells = K.confusion(K.labelled_calls(df))
    o = K.overall(cells).collect()[0]
    assert (o.total, o.correct, o.fault_runs, o.clean_runs) == (3, 2, 2, 1)
    s = {r.label: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in K.label_scores(cells).collect()}
    assert s == {"timeout": (1, 0, 0, 1.0, 1.0), "bad_stt": (0, 0, 1, None, 0.0), "ok": (1, 1, 0, 0.5, 1.0)}


def test_failure_impact_projection(spark):
    t = "2024-01-01 00:00:00"
    df = calls(spark, [(1, 1, "completed", None, None, "ok", .005, t), (2, 1, "failed", None, None, "timeout", .001, t), (3, 2, "failed", None, None, "timeout", None, t)])
    got = {r.owner_id: r for r in L.impact_projection(L.impact_totals(df), F.lit(1000), F.lit(10.0)).collect()}
    a, b = got[1], got[2]
    assert (a.basis, a.monthly_calls, a.monthly_failures) == ("your_calls", 30000, 3000)
    assert (round(a.monthly_spend_usd, 6), round(a.wasted_usd, 6), round(a.retry_usd, 6)) == (150, 3, 15)
    assert (b.basis, b.avg_call_usd, b.avg_failed_call_usd) == ("reference", 0.00408, 0.00408)


def test_stage_latency_fills_missing_stages(spark):
    t = "2024-01-01 00:00:00"
    c = calls(spark, [(1, 1, "completed", None, None, "ok", .1, t), (2, 1, "completed", None, None, "ok", .1, t), (3, 1, "failed", "timeout", None, "timeout", .1, t)])
    s = spark.createDataFrame([(1, "stt", 800, "ok"), (2, "stt", 1000, "ok"), (3, "stt", 9000, "timeout")], "call_id int, stage string, duration_ms int, status string")
    got = {r.stage: (r.n, r.p50_ms) for r in L.stage_limits_report(L.stage_latency(c, s)).collect()}
    assert got == {"stt": (2, 900.0), "llm": (0, None), "tts": (0, None)}


def verdict(spark, a, b):
    """a, b: lists of (status, cost, seconds, wer)."""
    rows = [(i, 1, side, st, cost, sec, wer, False, None, None, None) for side, runs in (("A", a), ("B", b)) for i, (st, cost, sec, wer) in enumerate(runs)]
    df = spark.createDataFrame(rows, "id int, ab_run_id int, ab_side string, status string, total_cost_usd double, pipeline_s double, wer double, stt_failover_occurred boolean, avg_confidence double, redacted_transcript string, intent string")
    return A.ab_verdict(A.ab_metrics(A.side_summary(df.withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))))).collect()[0]


OK = "completed"


@pytest.mark.parametrize("a, b, winner", [
    ([(OK, .003, 4.0, .05)], [(OK, .003, 4.0, .05)] * 3, "insufficient"),
    ([(OK, .003, 4.0, .05)] * 3, [(OK, .003, 4.1, .05)] * 3, "tie"),
    ([(OK, .003, 4.0, .05)] * 3, [(OK, .003, 6.0, .05)] * 3, "A"),
    ([(OK, .003, 4.0, .05)] * 3, [(OK, .002, 6.0, .05)] * 3, "tradeoff"),
    ([(OK, .003, 4.0, .15)] * 3, [(OK, .005, 6.0, .05)] * 3, "B"),
    ([(OK, .003, 4.0, .05)] * 3, [("failed", .001, 1.0, .05), (OK, .003, 4.0, .05), (OK, .003, 4.0, .05)], "tie"),
    ([(OK, .003, 4.0, .05)] * 3, [("failed", .001, 1.0, .05), ("failed", .001, 1.0, .05), (OK, .003, 4.0, .05)], "A"),
    ([(OK, .003, 4.0, .05), (OK, .003, 9.0, .05)], [(OK, .003, 8.0, .05), (OK, .003, 12.0, .05)], "tie"),
])
def test_verdicts(spark, a, b, winner):
    assert verdict(spark, a, b).winner == winner


def test_upsert_and_library_merge(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    delta = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {(r.k, r.v) for r in L.upsert(base, delta, ["k"]).collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_sections_round_trip(spark):
    text = "## Cause\nA.\n\n## Chain of events\n1. stt\n2. llm\n\n## Contributing factors\nnone\n\n## Recommendation\nDo it."
    row = reports.sections(spark.createDataFrame([(text,)], "report_text string")).collect()[0]
    assert (row.cause, row.chain, row.factors, row.recommendation) == ("A.", "1. stt\n2. llm", "none", "Do it.")


def test_malformed_rows_are_routed(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": '), (3, "no")], "i int, props string")
    good, bad = sinks.split_malformed(df, "props", "k BIGINT")
    assert [r.parsed.k for r in good.collect()] == [5] and {r.i for r in bad.collect()} == {2, 3}
    tries = []

    def broken(batch):
        tries.append(1)
        raise ValueError("sink is down")

    for _ in range(2):  # a batch that is run again replaces what it wrote
        sinks.route_batch("props", "k BIGINT", broken, str(tmp_path / "dead"))(df, 0)
    assert len(tries) == 6 and spark.read.parquet(str(tmp_path / "dead")).count() == 3


def test_recogniser_documents(spark, tmp_path):
    flat = {"id": "c1", "provider": "deepgram", "duration": 2.0, "words": [{"word": "hello", "punctuated_word": "Hello,", "confidence": .9, "start": .1, "end": .5, "speaker": 0}, {"word": "you", "confidence": .8}]}
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.json").write_text(json.dumps(flat))
    rows = recogniser.read_words(spark, str(tmp_path / "flat")).orderBy("pos").collect()
    assert [(r.word, r.start_ms, r.speaker) for r in rows] == [("Hello,", 100, 0), ("you", None, None)]
    seg = {"id": "c2", "text": "Hello there. Bye!", "duration": 3.0, "segments": [{"id": 0, "start": 0.0, "end": 1.0, "avg_logprob": -0.5, "no_speech_prob": 0.1}, {"id": 1, "start": 1.0, "end": 2.0, "avg_logprob": -1.0, "no_speech_prob": 0.3}],
           "words": [{"word": " Hello", "start": 0.0, "end": 0.5}, {"word": "there", "start": 0.5, "end": 1.5}, {"word": "Bye", "start": 2.5, "end": 2.8}]}
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "b.json").write_text(json.dumps(seg))
    rows = recogniser.read_segmented_words(spark, str(tmp_path / "seg")).orderBy("pos").collect()
    assert [r.word for r in rows] == ["Hello", "there.", "Bye!"]
    assert [round(r.confidence, 4) for r in rows] == [0.6065, 0.6065, round(float(np.exp(-0.75)), 4)]


def tone(rate, hz, seconds, amp=0.3, noise=0.0):
    t = np.arange(int(rate * seconds)) / rate
    x = sum(np.sin(2 * np.pi * hz * k * t) / k for k in range(1, 6)) * amp / 2 + np.random.default_rng(0).normal(0, noise, len(t))
    return wav(x, rate)


def wav(x, rate, channels=1):
    pcm = np.clip(np.round(x * 32767), -32768, 32767).astype("<i2").tobytes()
    le = lambda v, n: int(v).to_bytes(n, "little")
    return b"RIFF" + le(36 + len(pcm), 4) + b"WAVEfmt " + le(16, 4) + le(1, 2) + le(channels, 2) + le(rate, 4) + le(rate * 2 * channels, 4) + le(2 * channels, 2) + le(16, 2) + b"data" + le(len(pcm), 4) + pcm


def test_audio_frames_find_the_pitch_and_survive_bad_files(spark, tmp_path):
    (tmp_path / "low.wav").write_bytes(tone(16000, 110, 1.0))
    (tmp_path / "high.wav").write_bytes(tone(8000, 210, 1.0))
    for i, junk in enumerate([b"", b"RIFFxxxxWAVE", b"RIFF" + b"\0" * 60, tone(8000, 110, 1.0)[:50], b"x" * 5000]):
        (tmp_path / f"bad{i}.wav").write_bytes(junk)
    files = audio.audio_files(spark, str(tmp_path))
    f0 = {r.name: r.hz for r in audio.audio_frames(files).where("f0 > 0").groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.median("f0").alias("hz")).collect()}
    assert f0["low.wav"] == pytest.approx(110, abs=3) and f0["high.wav"] == pytest.approx(210, abs=6)
    cat = {r.id: r.duration_s for r in audio.catalog(files).collect()}
    assert cat["low.wav"] == 1.0 and cat["bad4.wav"] is None and len(cat) == 6  # Spark's binary source lists no empty files


def test_signal_conditions(spark):
    rng = np.random.default_rng(2)
    speech = np.concatenate([rng.normal(0, .2, 16000), rng.normal(0, .0005, 16000)] * 2)
    loud = np.clip(rng.normal(0, 1.2, 32000), -1, 1)
    rows = [("wide", wav(speech, 16000)), ("low_rate", wav(speech[::2], 8000)), ("clipped", wav(loud, 16000)), ("short", wav(speech[:4000], 16000))]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "path string, content binary")
    got = {r.path: r for r in audio.signal_quality(audio.signal_frames(df)).collect()}
    assert set(got) == {"wide", "low_rate", "clipped"}
    assert got["wide"].snr_db > 40 and not got["wide"].band_limited and got["low_rate"].band_limited
    assert got["clipped"].clipping_ratio > 0.1 and "clipped" in got["clipped"].condition.flags


def test_registered_names(spark):
    register.register(spark)
    assert spark.sql("SELECT number_tokens('twenty two ninety nine') AS n").collect()[0].n == ["22", "99"]
    rows = spark.sql("SELECT * FROM text_sections('## A\nx\n## B\ny')").collect()
    assert [(r.heading, r.body) for r in rows] == [("A", "x"), ("B", "y")]


def test_sql_names_follow_the_column_builders(spark, sf):
    register.register(spark)
    odd = ["mail a.b@c.de, card 4111 1111 1111 1111 or 4111111111111112", "call (415) 555-0132 or 1.2.3.4 5", "ssn 123-45-6789 x", "four one five, five five five zero one three two", "the twenty-first, 1,234.5 and twenty two", "", None]
    said = spark.read.parquet(f"{sf}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t in odd], "text string"))
    rows = said.withColumns({"value": F.expr("concat_ws(' ', slice(split(text, ' '), 3, 2))"), "one": F.regexp_extract("text", r"(\d[\d ,]*)", 1)})
    rows = G.with_value_in_text(G.with_value_in_text(G.with_numbers(rows, "text", "numbers"), "value", "text", "said"), "one", "text", "said_one")
    rows = rows.withColumn("clean", redaction.redact("text"))
    named = spark.sql("SELECT clean, redact(text) AS clean2, numbers, number_set(text) AS numbers2, said, value_in_text(value, text) AS said2, said_one, value_in_text(one, text) AS said_one2 FROM {rows}", rows=rows)
    for r in named.collect():
        assert (r.clean, r.numbers, r.said, r.said_one) == (r.clean2, r.numbers2, r.said2, r.said_one2)
    assert spark.sql("SELECT k % 2 AS g, nearest_rank(collect_list(CAST(k AS DOUBLE)), 0.5D) AS m FROM range(9) AS t(k) GROUP BY 1 ORDER BY 1").collect() == [(0, 4.0), (1, 5.0)]


def test_entry_and_catalog(spark):
    assert entry.entry(spark).count() == 3
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 150


def test_trailing_windows_read_only_the_folders_of_their_days(spark, tmp_path):
    rows = [(str(10 * d + k), f"2024-01-{d:02d} {6 * k:02d}:30:00", "failed" if k == 1 else "completed", "ab"[k % 2]) for d in range(1, 21) for k in range(4)]
    df = spark.createDataFrame(rows, "id string, t string, status string, owner_id string").selectExpr("id", "to_timestamp(t) AS started_at", "status", "owner_id", "CAST(0.1 AS decimal(18,9)) AS total_cost_usd")
    sinks.append_calls(df, f"{tmp_path}/calls")
    ledger = load_calls(spark, str(tmp_path))
    tenants = spark.createDataFrame([("a",), ("b",), ("idle",)], "owner_id string")
    config = spark.createDataFrame([("b", 10.0, 2 * 1440)], "owner_id string, max_failure_rate_pct double, window_minutes int")
    clock = ledger.agg(F.max("started_at")).scalar()  # known at run time only
    for made in (L.quota(ledger, F.expr("timestamp'2024-01-20 18:30:00'"), tenants=tenants), M.sla_status(ledger, config, F.expr("timestamp'2024-01-20 18:30:00'"), tenants)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*call_date#\d+ >= ", plan), plan
    used = {r.owner_id: (r.used, r.remaining) for r in L.quota(ledger, clock, tenants=tenants).collect()}
    assert used == {"a": (2, 23), "b": (2, 23), "idle": (0, 25)}
    status = {r.owner_id: (r.total, r.failed, r.window_minutes, r.breached) for r in M.sla_status(ledger, config, clock, tenants).collect()}
    assert status == {"a": (0, 0, 60, False), "b": (4, 2, 2880, False), "idle": (0, 0, 60, False)}


def test_quota_of_tenants_without_a_name(spark):
    df = calls(spark, [(1, None, "completed", None, None, "ok", .1, "2024-01-02 00:00:00"), (2, 4, "completed", None, None, "ok", .1, "2024-01-01 00:00:00")])
    got = {r.owner_id: r.used for r in L.quota(df, F.expr("timestamp'2024-01-02 00:00:00'")).collect()}
    assert got == {None: 1, 4: 0}


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from callgrain.sources.settle import shared_root

    def session(master, **conf):
        conf = {k.replace("_", "."): v for k, v in conf.items()}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d)), sparkContext=SimpleNamespace(master=master))

    assert shared_root(session("local[4]", spark_sql_warehouse_dir="/x/wh")) == "/x/wh/_work"
    assert shared_root(session("yarn", spark_sql_warehouse_dir="hdfs://n/wh")) == "hdfs://n/wh/_work"
    assert shared_root(session("local-cluster[2,1,1024]", spark_checkpoint_dir="file:///shared/")) == "file:///shared"
    for place in ("/x/wh", "file:/x/wh"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_root(session("spark://h:7077", spark_sql_warehouse_dir=place))
