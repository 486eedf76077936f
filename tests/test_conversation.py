"""Words to turns, boundaries, speakers and findings on small scenes, split over several chunks."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from callgrain.operators import conversation as C
from callgrain.operators import evaluation as E
from callgrain.operators import findings as N
from callgrain.operators import intervals as I
from callgrain.operators import speakers as P
from callgrain.operators import voices as O
from callgrain.operators.quantiles import nearest_rank_by
from callgrain.operators.sequence import islands, neighbours, running_sum
from callgrain.sources.views import frames_view, words_view

WORDS = "call_id long, chunk long, turn long, pos long, word string, speaker int, start_ms long, end_ms long, confidence double"


def words_df(spark, items, chunk=3, call=1):
    """items: (word, speaker, start_s, end_s[, confidence])"""
    rows = [(call, i // chunk, 0, i, w[0], w[1], None if w[2] is None else round(w[2] * 1000), None if w[3] is None else round(w[3] * 1000), float(w[4]) if len(w) > 4 else 0.95) for i, w in enumerate(items)]
    return spark.createDataFrame(rows, WORDS)


def spoken(text, speaker, start, step=0.3, gap=0.05):
    out = []
    for w in text.split():
        out.append((w, speaker, round(start, 3), round(start + step, 3)))
        start += step + gap
    return out


def test_sequence_helpers_equal_plain_windows(spark):
    rng = random.Random(1)
    rows = [(k, i // 4, i, rng.randint(-3, 5), rng.choice([None, 1, 2])) for k in range(3) for i in range(41)]
    df = spark.createDataFrame(rows, "k long, chunk long, i long, v long, s long")
    key = dict(key=["k"], chunk="chunk", order=["i"])
    sums = {(r.k, r.i): r.t for r in running_sum(df, sums={"t": F.col("v")}, **key).collect()}
    near = {(r.k, r.i): (r.p, r.n) for r in neighbours(df, previous={"p": "v"}, following={"n": "v"}, **key).collect()}
    among = {(r.k, r.i): (r.p, r.n) for r in neighbours(df, previous={"p": "i"}, following={"n": "i"}, among=F.col("s").isNotNull(), **key).collect()}
    runs = {(r.k, r.i): r.g for r in islands(df, uses=["s"], starts=lambda c, p: ~c("s").eqNullSafe(p("s")), name="g", **key).collect()}
    for k in range(3):
        mine = [r for r in rows if r[0] == k]
        total, g = 0, 0
        for j, r in enumerate(mine):
            total += r[3]
            g += j == 0 or mine[j - 1][4] != r[4]
            assert sums[k, r[2]] == total and runs[k, r[2]] == g
            assert near[k, r[2]] == (mine[j - 1][3] if j else None, mine[j + 1][3] if j + 1 < len(mine) else None)
            before = [x[2] for x in mine[:j] if x[4] is not None]
            after = [x[2] for x in mine[j + 1:] if x[4] is not None]
            assert among[k, r[2]] == (before[-1] if before else None, after[0] if after else None)


def test_nearest_rank_by_is_exact(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"g{i % 5}", round(rng.gauss(0, 30), 2)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    for p in (0.0, 0.1, 0.5, 0.9, 1.0):
        got = {r.g: r.x for r in nearest_rank_by(df, ["g"], "v", {"x": p}, width=5.0).collect()}
        for g in {r[0] for r in rows}:
            vs = sorted(r[1] for r in rows if r[0] == g)
            assert got[g] == vs[min(len(vs) - 1, int(len(vs) * p))]


def test_turns_merge_unknown_speakers_and_mark_uncertain(spark):
    df = words_df(spark, [("a", 0, 0, .2, .9), ("b", 0, .3, .5, .9), ("c", None, .6, .8, .2), ("d", None, .9, 1, .2), ("e", 0, 1.1, 1.2, .5)])
    got = [(r.text, r.speaker, r.confidence, r.uncertain) for r in C.turns(df).orderBy("turn_id").collect()]
    assert got == [("a b", 0, 0.9, False), ("c d", None, 0.2, True), ("e", 0, 0.5, True)]


@pytest.mark.parametrize("second, start2, kind, confidence", [
    ("Yes it is late.", 1.30, "simultaneous", 0.9),
    ("okay, sure.", 1.75, "backchannel", 0.75),
    ("No stop there.", 1.80, "interruption", 0.7),
    ("No stop there.", 2.60, "transition", 0.7),
])
def test_boundary_kinds(spark, second, start2, kind, confidence):
    first = spoken("I want to know the", 0, 0.0)
    reply = spoken(second, 1, start2)
    last = spoken("answer now.", 0, 6.0)
    b = C.boundaries(C.turns(words_df(spark, first + reply + last))).orderBy("turn_id").collect()
    assert (b[0].kind, b[0].confidence) == (kind, confidence)
    assert b[1].kind == "transition" and b[0].at == pytest.approx(start2)


def test_pauses_and_metrics(spark):
    items = [("um,", 0, 0.0, 0.5, .9), ("hello", 0, 0.6, 1.0, .5), ("there.", 0, 2.0, 2.4, .9), ("bye", 0, 4.2, 4.6, .6), ("x", 0, None, None, .9)]
    df = words_df(spark, items, chunk=2)
    t = C.turns(df)
    m = C.speech_metrics(df, t, C.boundaries(t)).collect()[0]
    assert (m.word_count, m.filler_count, m.pause_count, m.long_pause_count, m.longest_pause_s) == (5, 1, 2, 1, 1.8)
    assert m.words_per_minute == round(5 / 4.6 * 60) and m.low_confidence_words == ["hello", "bye"]
    none = C.speech_metrics(df.withColumn("word_confidence", F.lit(False)), t, C.boundaries(t)).collect()[0]
    assert none.avg_confidence is None and none.low_confidence_words == [] and none.low_confidence_ratio == 0


def test_timeline_layout_equals_loop(spark):
    rng = random.Random(3)
    lines = [(k, i, rng.randint(-4000, 900), rng.randint(100, 1500)) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(lines, "k long, i long, gap long, dur long").withColumn("c", F.expr("i div 7"))
    got = {(r.k, r.i): (r.start_at, r.end_at) for r in C.timeline_layout(df, key=["k"], order="i", gap="gap", duration="dur", chunk="c").collect()}
    for k in range(3):
        end = 0
        for kk, i, gap, dur in lines:
            if kk == k:
                start = max(0, end + gap)
                end = start + dur
                assert got[k, i] == (start, end)


def viterbi(costs, switch):
    a, back = list(costs[0]), []
    for c, sw in zip(costs[1:], switch[1:]):
        step, new = [], []
        for k in (0, 1):
            stay, move = a[k], a[1 - k] + sw
            step.append(1 - k if move < stay else k)
            new.append(min(stay, move) + c[k])
        a, back = new, [*back, step]
    k = 1 if a[1] < a[0] else 0
    path = [k]
    for step in reversed(back):
        k = step[k]
        path.append(k)
    return path[::-1]


def test_smoothing_over_chunks_equals_one_pass(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for call in range(4):
        t, costs, sw = 0, [], []
        for i in range(57):
            gap = rng.choice([40, 40, 40, 500])
            word = rng.choice(["a", "b", "c."])
            costs.append((rng.uniform(0, 30), rng.uniform(0, 30)))
            prev = rows[-1] if i else None
            easy = i and (gap >= 350 or prev[4].endswith("."))
            sw.append(8.0 if easy else 20.0)
            rows.append((call, i // 5, 0, i, word, t + gap, t + gap + 200, *costs[-1]))
            t += gap + 200
        want.update({(call, i): p for i, p in enumerate(viterbi(costs, sw))})
    df = spark.createDataFrame(rows, "call_id long, chunk long, turn long, pos long, word string, start_ms long, end_ms long, c0 double, c1 double")
    got = {(r.call_id, r.pos): r.voice for r in P.smooth_two_voices(df).collect()}
    assert got == want


def repaired(seq):
    """seq: list of (voice, start, end); one fix per pass until nothing changes."""
    v = [s[0] for s in seq]
    while True:
        runs = []
        for i, x in enumerate(v):
            if runs and runs[-1][2] == x:
                runs[-1][1] = i
            else:
                runs.append([i, i, x])
        for r in range(1, len(runs) - 1):
            a, b, _ = runs[r]
            if b - a + 1 <= 2 and runs[r - 1][2] == runs[r + 1][2] and seq[a][1] - seq[a - 1][2] < 300 and seq[b + 1][1] - seq[b][2] < 300:
                v[a:b + 1] = [runs[r - 1][2]] * (b - a + 1)
                break
        else:
            return v


def test_short_run_repair_equals_repeated_passes(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for call in range(5):
        t, seq = 0, []
        for i in range(60):
            t += rng.choice([50, 50, 50, 400])
            seq.append((rng.choice([0, 0, 1]), t, t + 100))
            t += 100
        want.update({(call, i): x for i, x in enumerate(repaired(seq))})
        rows += [(call, i // 6, 0, i, s[1], s[2], s[0], 0.9) for i, s in enumerate(seq)]
    df = spark.createDataFrame(rows, "call_id long, chunk long, turn long, pos long, start_ms long, end_ms long, voice int, attribution double")
    out = P.repair_short_runs(df).collect()
    assert {(r.call_id, r.pos): r.voice for r in out} == want
    before = {(r[0], r[3]): r[6] for r in rows}
    assert all((r.attribution == 0.5) == (before[r.call_id, r.pos] != r.voice) or r.voice == before[r.call_id, r.pos] for r in out)


def scene(lines, hop=10):
    """(f0, start_s, text, level) lines -> words and frames of a call."""
    words, frames = [], []
    for f0, start, text, level in lines:
        for w in spoken(text, None, start):
            words.append(w)
            for i in range(round(w[2] * 100), round(w[3] * 100)):
                frames.append((1, i, float(f0 + i % 3), float(level), -80.0))
    return words, frames


TALK = "this is a line of speech that runs on."


def attribute(spark, lines, recognised=None):
    words, frames = scene(lines)
    df = words_df(spark, words, chunk=4).drop("speaker").withColumn("recognised", F.lit(recognised).cast("int"))
    fr = spark.createDataFrame(frames, "call_id long, frame_idx long, f0 double, db double, floor_db double")
    out, summary = P.attribute(df, fr, 10.0)
    return [(r.word, r.voice, r.background) for r in out.orderBy("pos").collect()], summary.collect()[0]


def test_two_voices_found_from_the_audio(spark):
    lines = [(210, 0, TALK, -20), (110, 5, TALK, -20), (210, 10, TALK, -20), (110, 15, TALK, -20)]
    words, s = attribute(spark, lines, recognised=0)
    assert (s.speakers, s.source, s.reliable, s.recogniser_speakers) == (2, "acoustic", True, 1)
    assert [v for _, v, _ in words] == [0] * 9 + [1] * 9 + [0] * 9 + [1] * 9
    assert s.voice_pitch_hz[0] > 200 > 120 > s.voice_pitch_hz[1]


def test_attribution_leaves_short_plans(spark):
    """The results read settled tables: tens of repeated steps in a plan cost the driver more memory than the rows."""
    words, frames = scene([(210, 0, TALK, -20), (110, 5, TALK, -20)])
    df = words_df(spark, words, chunk=4).drop("speaker").withColumn("recognised", F.lit(0))
    fr = spark.createDataFrame(frames, "call_id long, frame_idx long, f0 double, db double, floor_db double")
    for out in P.attribute(df, fr, 10.0):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") < 12 and plan.count("Window [") < 4


def test_recordings_are_made_a_few_at_a_time(spark, tmp_path):
    """A batch of rows is rendered in pieces, so that Python holds a few recordings, not those of the whole batch."""
    from callgrain.plans import speech

    rows = spark.range(0, 2000, 1, 1).selectExpr("id AS vec_id", "transform(sequence(0, 63), i -> CAST((i * 7 + id) % 11 - 5 AS FLOAT)) AS embedding")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))

    def sizes(batches):
        for b in batches:
            yield b[["path"]].iloc[:1].assign(path=str(len(b)))

    clips = speech.recordings(spark, str(tmp_path))
    assert clips.count() == 2000
    assert max(int(r.path) for r in clips.mapInPandas(sizes, "path string").collect()) <= 400
    audio = clips.where("path LIKE '%clip-7.wav' OR path LIKE '%clip-1999.wav'").selectExpr("length(content) AS n").collect()
    assert [r.n for r in audio] == [32044, 32044]


def test_one_voice_is_not_split(spark):
    lines = [(140, 0, TALK, -20), (146, 5, TALK, -20), (150, 10, TALK, -20), (143, 15, TALK, -20)]
    words, s = attribute(spark, lines)
    assert (s.speakers, s.source) == (1, "single_voice") and {v for _, v, _ in words} == {0}


def test_quiet_foreign_voice_is_background_and_quiet_known_voice_is_not(spark):
    base = [(210, 0, TALK, -20), (110, 5, TALK, -20), (210, 10, TALK, -20), (110, 15, TALK, -20)]
    words, _ = attribute(spark, [*base, (330, 20, "a far television talks on here.", -40)])
    assert all(b == (i >= 36) for i, (_, _, b) in enumerate(words))
    words, _ = attribute(spark, [*base, (110, 20, "i say this very softly now.", -40)])
    assert not any(b for _, _, b in words)


def test_nearest_fill_prefers_the_earlier_word(spark):
    rows = [(1, i // 2, 0, i, v, 0.9 if v is not None else 0.0, False) for i, v in enumerate([None, 0, None, None, None, 1, None])]
    df = spark.createDataFrame(rows, "call_id long, chunk long, turn long, pos long, voice int, attribution double, background boolean")
    got = [(r.voice, r.attribution) for r in P.fill_from_nearest(df).orderBy("pos").collect()]
    assert got == [(0, .55), (0, .9), (0, .55), (0, .55), (1, .55), (1, .9), (1, .55)]


def test_delivery_needs_agreeing_cues_and_a_clean_recording(spark):
    cols = "call_id int, speech_s double, articulation_wpm double, pitch_range_st double, loudness_sd_db double, pause_ratio double, long_pauses int, fillers_per_min double, snr_db double, band_limited boolean, clipping_ratio double, dynamics_compressed boolean"
    rows = [
        (1, 20.0, 180.0, 12.0, 5.0, .1, 0, 0.0, 30.0, False, 0.0, False), (2, 20.0, 110.0, 4.0, 3.0, .1, 0, 0.0, 30.0, False, 0.0, False),
        (3, 5.0, 180.0, 12.0, 5.0, .1, 0, 0.0, 30.0, False, 0.0, False), (4, 20.0, 180.0, 4.0, 5.0, .1, 0, 0.0, 30.0, False, 0.0, False),
        (5, 20.0, 180.0, 12.0, 5.0, .1, 0, 0.0, 10.0, False, 0.0, False), (6, 20.0, 145.0, 8.0, 5.0, .3, 2, 0.0, 20.0, True, 0.0, False),
    ]
    got = {r.call_id: (r.arousal, r.voice_confidence, r.cues) for r in O.judge_delivery(spark.createDataFrame(rows, cols)).collect()}
    assert got == {
        1: ("high", "medium", ["fast", "wide_pitch"]), 2: ("low", "medium", ["slow", "narrow_pitch", "steady_loudness"]), 3: ("unclear", "low", ["fast", "wide_pitch"]),
        4: ("unclear", "low", ["fast", "narrow_pitch"]), 5: ("unclear", "low", ["fast", "wide_pitch"]), 6: ("medium", "low", ["hesitant"]),
    }


def test_findings_absent_measurements_say_nothing(spark):
    df = spark.createDataFrame([(1,)], "call_id long")
    row = N.with_findings(df).select("findings", N.difficulty(F.col("findings")).alias("d")).collect()[0]
    assert row.findings == [] and (row.d.score, row.d.label) == (0.0, "Easy")


def test_scripted_words_and_background(spark):
    words = words_df(spark, [("a", 0, 0.0, 0.2), ("b", 0, 1.0, 1.2), ("c", 0, 1.9, 2.1), ("d", 0, 3.4, 3.6)]).withColumn("background", F.col("word").isin("a", "d"))
    truth = spark.createDataFrame([(1, 0, "customer", 0, 1150), (1, 1, "agent", 1100, 3000)], "call_id long, turn long, who string, start_ms long, end_ms long")
    got = {r.pos: r.who for r in I.scripted_speaker(words, truth).collect()}
    assert got == {0: "customer", 2: "agent"}  # b lies in both lines
    s = E.background_scores(words, truth).collect()[0]
    assert (s.tp, s.fn, s.fp) == (1, 0, 1)


def test_a_call_of_which_only_a_transcript_is_left_is_one_turn(spark):
    words = spark.createDataFrame([(1, 0, 0, 0, "hi", 0, 300, 0, 0.9)], "call_id int, chunk long, turn long, pos long, word string, start_ms long, end_ms long, speaker int, confidence double")
    said = spark.createDataFrame([(1, "ignored, it has words"), (2, " \u00a0 hello there \n"), (3, " \t\u3000"), (4, None)], "call_id int, transcript string")
    got = {r.call_id: r for r in C.with_bare_transcripts(C.turns(words), words, said).collect()}
    assert set(got) == {1, 2} and got[1].text == "hi"
    assert (got[2].speaker, got[2].start_ms, got[2].end_ms, got[2].text, got[2].confidence, got[2].uncertain) == (0, None, None, "hello there", 0.5, False)


def test_calls_without_audio_or_words(spark):
    schema = "call_id int, chunk long, turn long, pos long, word string, start_ms long, end_ms long, speaker int, recognised int, confidence double"
    word = lambda call, pos, label: (call, 0, 0, pos, "w", 300 * pos, 300 * pos + 200, label, label, 0.9)
    words = spark.createDataFrame([word(1, 0, 0), word(1, 1, 1), word(2, 0, None), word(3, 0, 0)], schema)
    calls = spark.createDataFrame([(1,), (2,), (3,), (4,)], "call_id int")
    frames = spark.createDataFrame([(3, k, 120.0, -20.0, -60.0) for k in range(8)], "call_id int, frame_idx long, f0 double, db double, floor_db double")
    made, summary = P.attribute_calls(calls, words, frames, 50)
    got = {r.call_id: r for r in summary.collect()}
    assert [(got[k].speakers, got[k].source, got[k].reliable, got[k].recogniser_speakers) for k in (1, 2, 4)] == [(2, "recognizer", False, 2), (1, "unavailable", False, 0), (0, "unavailable", False, 0)]
    assert got[1].notes == got[2].notes != got[4].notes and got[3].source == "single_voice"
    labels = {(r.call_id, r.pos): (r.voice, r.attribution, r.background) for r in made.collect()}
    assert labels[1, 1] == (1, 0.5, False) and labels[2, 0] == (None, 0.0, False)


def test_speakers_and_duration_of_the_metrics(spark):
    words = spark.createDataFrame([(1, 0, 0, k, "word", 400 * k, 400 * k + 300, 0, 0.9) for k in range(10)], "call_id int, chunk long, turn long, pos long, word string, start_ms long, end_ms long, speaker int, confidence double")
    t = C.turns(words)
    known = spark.createDataFrame([(1, 2, 7.5)], "call_id int, speakers int, duration_s double")
    a, b = C.speech_metrics(words, t, C.boundaries(t), known).first(), C.speech_metrics(words, t, C.boundaries(t)).first()
    assert (a.speakers, a.duration_s, b.speakers, b.duration_s) == (2, 7.5, 1, None)


def test_frames_are_dealt_before_they_are_made(spark, sf):
    frames, words = frames_view(spark, sf), words_view(spark, sf)
    want = Counter()
    for w in words.select("call_id", "turn", "pos", "speaker", "start_ms", "end_ms").collect():
        lo, hi = w.start_ms // 50, (w.end_ms - 1) // 50
        aside = w.turn % 7 == 5
        base = 330.0 if aside else 110.0 if w.speaker == "user" else 210.0
        want.update((w.call_id, i, base + (i * 7 + w.pos * 3) % 11, (-44.0 if aside else -20.0) + i * 5 % 7) for i in range(min(lo, hi), max(lo, hi) + 1))
    assert Counter(tuple(r) for r in frames.select("call_id", "frame_idx", "f0", "db").collect()) == want
    spans = C.phrase_spans(C.phrases(words)).select("call_id", "phrase_id", "start_ms", "end_ms")
    plan = I.span_features(frames, spans, span_key=["call_id", "phrase_id"], hop_ms=50)._jdf.queryExecution().executedPlan().toString()
    under = [line for line in plan.splitlines() if "__islot" in line and "Join" in line]
    assert under and all("ShuffledHashJoin" in line for line in under)  # frames are not sorted
    assert not re.search(r"Exchange hashpartitioning\([^)]*(__pslot|frame_slot)[^)]*\), ENSURE", plan)  # nor dealt one by one
    assert not re.search(r"Exchange [^\n]*ENSURE_REQUIREMENTS[^\n]*\n[^\n]*Generate posexplode", plan)


def test_frames_without_slots_give_the_same_features(spark, sf):
    frames = frames_view(spark, sf)
    spans = C.phrase_spans(C.phrases(words_view(spark, sf))).select("call_id", "phrase_id", "start_ms", "end_ms")
    rows = lambda f: Counter(tuple(r) for r in I.span_features(f, spans, span_key=["call_id", "phrase_id"], hop_ms=50).collect())
    assert rows(frames) == rows(frames.drop("frame_slot"))


def test_attribution_settles_few_columns_and_deletes_what_it_has_read(spark, sf, monkeypatch):
    """Frames and texts are not written, and of the tables between the steps those are left that the results read."""
    from pathlib import Path

    from callgrain.plans import speech

    speech.settle(spark.range(1))
    folder, columns = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")), []
    before, settle = set(folder.iterdir()), speech.settle
    monkeypatch.setattr(speech, "settle", lambda df: columns.append(df.columns) or settle(df))
    words, summary = speech.attributed(spark, sf)
    assert len(columns) > 8 and not {"frame_idx", "word", "confidence", "speaker"} & {c for names in columns for c in names}
    assert len(set(folder.iterdir()) - before) <= 4
    assert words.columns == ["call_id", "turn", "pos", "background", "voice", "attribution"]
    assert words.count() == words_view(spark, sf).count() and summary.count() == words_view(spark, sf).select("call_id").distinct().count()


def test_attribution_keeps_the_columns_asked_for(spark):
    words, frames = scene([(210, 0, TALK, -20), (110, 5, TALK, -20), (210, 10, TALK, -20), (110, 15, TALK, -20)])
    df = words_df(spark, words, chunk=4).drop("speaker").withColumn("recognised", F.lit(None).cast("int"))
    fr = spark.createDataFrame(frames, "call_id long, frame_idx long, f0 double, db double, floor_db double")
    every, _ = P.attribute(df, fr, 10.0)
    some, _ = P.attribute(df, fr, 10.0, carry=["end_ms"])
    assert every.columns == [*df.columns, "background", "voice", "attribution"] and some.columns == ["call_id", "turn", "pos", "end_ms", "background", "voice", "attribution"]
    assert sorted(every.select(some.columns).collect()) == sorted(some.collect())
