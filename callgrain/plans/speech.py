"""Classification, speakers, voices, audio and findings; scoring against labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import spoken as S
from callgrain.functions.columns import ratio
from callgrain.operators import classify, findings
from callgrain.operators import conversation as C
from callgrain.operators import evaluation as E
from callgrain.operators import intervals as I
from callgrain.operators import speakers as P
from callgrain.operators import voices as O
from callgrain.plans.conversation import METRICS
from callgrain.plans.ledger import rounded
from callgrain.plans.monitors import FIRST_FIT, SCORES
from callgrain.plans.registry import Catalog
from callgrain.sources import audio, recogniser, sinks
from callgrain.sources.settle import settle
from callgrain.sources.views import acted_words_view, calls_view, frames_view, stages_view, table, words_view
from callgrain.streaming.source import work_dir

catalog = Catalog()
q = catalog.query
HOP_MS = 50
CLIPS = 64  # recordings made at a time: some 2 MB

SIGNALS = """SELECT id, stt_provider_used AS provider, COALESCE(injected_fault = 'network_drop', false) AS nd, COALESCE(injected_fault = 'user_hangup', false) AS hu, CASE WHEN injected_fault = 'exception' THEN 'TypeError' ELSE '' END AS ex,
 COALESCE(injected_fault = 'hallucination', false) AS ha, id % 97 = 0 AS em, (id % 64) / 64.0 AS conf, COALESCE(injected_fault = 'tts_glitch', false) AS mm FROM calls_v"""


def signals(spark, d):
    fault = F.col("injected_fault")
    return calls_view(spark, d).select(
        "id", "stt_provider_used", (fault == "network_drop").alias("network_dropped"), (fault == "user_hangup").alias("hung_up"),
        F.when(fault == "exception", "TypeError").alias("exception_type"), (fault == "hallucination").alias("hallucinated"),
        (F.col("id") % 97 == 0).alias("transcript_empty"), ((F.col("id") % 64) / 64.0).alias("stt_confidence"), (fault == "tts_glitch").alias("reply_mismatch"))


@q("f08_classify", f"""
WITH slow AS (SELECT call_id, arg_min('stage ' || stage || ' exceeded SLA (' || duration_ms || 'ms > ' || lim || 'ms)', (CASE stage WHEN 'stt' THEN 0 WHEN 'llm' THEN 1 ELSE 2 END, started_at, part_key, duration_ms, status)) AS why
  FROM (SELECT *, CASE stage WHEN 'llm' THEN 8000 ELSE 5000 END AS lim FROM stages_v WHERE stage IN ('stt', 'llm', 'tts')) s WHERE status = 'timeout' OR duration_ms > lim GROUP BY 1)
SELECT id, CASE WHEN nd THEN 'network_drop' WHEN hu THEN 'user_hangup' WHEN ex <> '' THEN 'exception' WHEN why IS NOT NULL THEN 'timeout' WHEN ha THEN 'hallucination' WHEN em THEN 'bad_stt' WHEN conf > 0 AND conf < thr THEN 'bad_stt' WHEN mm THEN 'tts_glitch' ELSE 'ok' END AS category,
 CASE WHEN nd OR hu THEN 1.0 WHEN ex <> '' OR why IS NOT NULL THEN 0.95 WHEN ha OR em THEN 0.85 WHEN conf > 0 AND conf < thr THEN 0.9 WHEN mm THEN 0.8 ELSE 0.9 END::DOUBLE AS confidence,
 CASE WHEN nd THEN 'websocket close event received' WHEN hu THEN 'user cancellation signal received' WHEN ex <> '' THEN 'unhandled TypeError caught' WHEN why IS NOT NULL THEN why WHEN ha THEN 'grounding check flagged response' WHEN em THEN 'speech-to-text returned an empty transcript'
  WHEN conf > 0 AND conf < thr THEN 'low' WHEN mm THEN 'tts duration mismatch vs. expected' ELSE 'no failure signals' END AS reason
FROM (SELECT *, CASE provider WHEN 'deepgram' THEN 0.85 ELSE 0.6 END AS thr FROM ({SIGNALS}) g) c LEFT JOIN slow ON call_id = id
""", ("calls_v", "stages_v"))
def classified(spark, d):
    out = classify.classify(signals(spark, d), stages_view(spark, d), ["started_at", "part_key", "duration_ms", "status"])
    return out.withColumn("reason", F.when(F.col("reason").startswith("avg STT"), "low").otherwise(F.col("reason")))


# ------------------------------------------------------------ recogniser output


def segments(spark, d):
    w = words_view(spark, d)
    lines = w.groupBy("call_id", "turn").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).where("turn % 5 <> 4")
    return lines.select("call_id", F.col("turn").alias("segment_id"), F.col("start_ms"), F.col("end_ms"), (-((F.col("turn") * 3 + F.col("call_id")) % 16) / 8.0).alias("avg_logprob"), ((F.col("turn") % 4) / 8.0).alias("no_speech_prob"))


SEGMENTS = """SELECT call_id, turn AS segment_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, -((turn * 3 + call_id) % 16) / 8.0 AS avg_logprob, (turn % 4) / 8.0 AS no_speech_prob FROM words_v WHERE turn % 5 <> 4 GROUP BY call_id, turn"""


@q("s04_segment_confidence", f"""
WITH s AS ({SEGMENTS}), m AS (SELECT call_id, avg(avg_logprob) AS lp FROM s GROUP BY 1),
f AS (SELECT w.call_id, w.turn, w.pos, arg_min(s.avg_logprob, s.segment_id) AS lp FROM words_v w JOIN s ON s.call_id = w.call_id AND w.start_ms + w.end_ms BETWEEN 2 * s.start_ms AND 2 * s.end_ms GROUP BY 1, 2, 3)
SELECT w.call_id, w.turn, w.pos, round(least(1, greatest(0, exp(COALESCE(f.lp, m.lp)))), 9) AS confidence FROM words_v w JOIN m USING (call_id) LEFT JOIN f USING (call_id, turn, pos)
""", ("words_v",))
def segment_confidence(spark, d):
    out = recogniser.confidence_from_segments(words_view(spark, d).drop("confidence"), segments(spark, d))
    return out.select("call_id", "turn", "pos", F.round("confidence", 9).alias("confidence"))


@q("t17_log_confidence", f"SELECT call_id, round(exp(avg(avg_logprob)), 9) AS mean_confidence, round(avg(no_speech_prob), 9) AS no_speech_prob FROM ({SEGMENTS}) s GROUP BY 1", ("words_v",))
def log_confidence(spark, d):
    return rounded(recogniser.segment_averages(segments(spark, d)).drop("mean_logprob"))


@q("s05_reattached_punctuation", r"""
SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[^.,!?;:"'')…-]')), ' ') AS said FROM conversations
""")
def reattached_punctuation(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.filter(
        F.transform(F.split("text", r"\s+"), lambda w: F.regexp_replace(w, r"[.,!?;:\"')…-]+$", "")), lambda w: w != "").alias("bare"))
    return rows.select("conv_id", "turn", F.array_join(recogniser.reattach_punctuation("bare", "text"), " ").alias("said"))


# ---------------------------------------------------------------------- speakers


@q("w09_two_groups", """
WITH v AS (SELECT l_linenumber AS k, l_orderkey * 100 + l_suppkey AS tie, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 11.0 + l_linenumber % 3 END + l_discount * 8 AS x, CAST(l_quantity AS DOUBLE) AS w, l_partkey FROM lineitem),
s AS (SELECT k, x, sum(w) OVER o AS lw, sum(w * x) OVER o AS lx, sum(w * x * x) OVER o AS lxx, lead(x) OVER (PARTITION BY k ORDER BY x, tie, l_partkey) AS nx, sum(w) OVER (PARTITION BY k) AS tw, sum(w * x) OVER (PARTITION BY k) AS tx, sum(w * x * x) OVER (PARTITION BY k) AS txx
  FROM v WINDOW o AS (PARTITION BY k ORDER BY x, tie, l_partkey ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (tx - lx) / (tw - lw) - lx / lw AS delta, sqrt((greatest(0, lxx - lx * lx / lw) + greatest(0, txx - lxx - (tx - lx) * (tx - lx) / (tw - lw))) / tw) AS pooled FROM s WHERE nx IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY delta * delta * lw * (tw - lw) DESC) AS r FROM c)
SELECT k, round((x + nx) / 2, 6) AS cut, round(delta, 6) AS delta, round(delta / greatest(pooled, 0.8), 6) AS dprime, delta >= 5.5 AND delta / greatest(pooled, 0.8) >= 3.5 AND least(lw, tw - lw) / 100 >= 1 AS accepted FROM b WHERE r = 1
""")
def two_groups(spark, d):
    rows = table(spark, d, "lineitem").selectExpr(
        "l_linenumber AS k", "l_orderkey * 1000000 + l_suppkey * 10000 + l_partkey AS tie",
        "CASE WHEN l_returnflag = 'R' THEN 1.0D ELSE 11.0D + l_linenumber % 3 END + l_discount * 8 AS x", "l_quantity AS w")
    out = P.two_groups(rows, key=["k"], value="x", weight="w", tie="tie", bin_width=0.5)
    return rounded(out.select("k", "cut", "delta", "dprime", "accepted"), 6)


def heard_words(spark, d):
    """Recogniser labels that miss the second voice in some calls and are wrong now and then."""
    one_voice = (F.col("call_id") % 7 == 3) | (F.col("call_id") % 4 == 0)
    label = F.when(one_voice, F.lit(0)).when((F.col("speaker") == "user") != (F.col("pos") % 13 == 5), 0).otherwise(1)
    return words_view(spark, d).withColumn("recognised", label).drop("speaker")


def attributed(spark, d):
    return P.attribute(heard_words(spark, d), frames_view(spark, d, HOP_MS), HOP_MS, settle, carry=())


@q("w10_w13_word_attribution")
def word_attribution(spark, d):
    words, _summary = attributed(spark, d)
    return rounded(words.select("call_id", "turn", "pos", "voice", "attribution", "background"), 2)


@q("w15_attribution_summary")
def attribution_summary(spark, d):
    _words, summary = attributed(spark, d)
    return summary.withColumns({"notes": F.array_join("notes", " "), "voice_pitch_hz": F.array_join(F.col("voice_pitch_hz").cast("array<string>"), ",")})


@q("w15_unheard_calls", """
WITH k AS (SELECT call_id, count(DISTINCT CASE WHEN call_id % 2 = 0 THEN speaker = 'user' END) AS n FROM words_v GROUP BY 1)
SELECT call_id, CAST(greatest(n, 1) AS INT) AS speakers, CASE WHEN n > 0 THEN 'recognizer' ELSE 'unavailable' END AS source, false AS reliable, n AS recogniser_speakers,
 'Audio could not be analysed, so speaker labels come from the speech recogniser only and were not verified.' AS notes FROM k
UNION ALL SELECT doc_id + 1000000000, 0, 'unavailable', false, 0, 'This transcript has no word timings, so speakers could not be separated.' FROM documents
""", ("words_v",))
def unheard_calls(spark, d):
    """No call has audio: conversations have words, with the recogniser's labels in every other one, documents are transcripts only."""
    words = words_view(spark, d).withColumn("recognised", F.when(F.col("call_id") % 2 == 0, F.when(F.col("speaker") == "user", 0).otherwise(1)))
    calls = words.select("call_id").union(table(spark, d, "documents").select((F.col("doc_id") + 1_000_000_000).alias("call_id")))
    return P.unheard_summary(calls, words).select("call_id", "speakers", "source", "reliable", "recogniser_speakers", F.array_join("notes", " ").alias("notes"))


@q("w14_background_phrases")
def background_phrases(spark, d):
    words = settle(words_view(spark, d))
    numbered = C.phrases(words)
    fg = settle(P.foreground(settle(P.measured_phrases(words, frames_view(spark, d, HOP_MS), HOP_MS))))
    return P.background_words(numbered, fg, P.voices_per_call(P.voice_groups(fg)))


def labelled_words(spark, d):
    return words_view(spark, d).withColumn("voice", F.when(F.col("speaker") == "user", 0).otherwise(1))


def voice_rows(spark, d):
    return O.measure_voices(labelled_words(spark, d), frames_view(spark, d, HOP_MS), HOP_MS)


_NR = "{v}[CAST(least(len({v}) - 1, floor(len({v}) * {p})) AS BIGINT) + 1]"


VOICES = f"""
WITH w AS (SELECT *, CASE WHEN speaker = 'user' THEN 0 ELSE 1 END AS voice FROM words_v),
g AS (SELECT *, (start_ms - lag(end_ms) OVER (PARTITION BY call_id, voice ORDER BY turn, pos)) / 1000.0 AS gap FROM w),
b AS (SELECT call_id, voice, count(*) AS n, count(*) FILTER (WHERE regexp_replace(lower(word), '[^a-z]', '', 'g') IN ('uh','um','uhm','uhh','umm','er','erm','ah','hmm','mm','mmm')) AS fl, COALESCE(sum(gap) FILTER (WHERE gap > 0.3 AND gap < 8), 0) AS pause, count(*) FILTER (WHERE gap > 1 AND gap < 8) AS lp,
  (max(end_ms) - min(start_ms)) / 1000.0 AS span FROM g GROUP BY 1, 2 HAVING count(*) >= 5),
f AS (SELECT w.call_id, w.voice, count(*) AS fr, list(12 * log2(f0 / 100) ORDER BY f0) AS st, stddev_pop(db) AS sd FROM w JOIN frames_v f ON f.call_id = w.call_id AND f.frame_idx >= floor(w.start_ms / 50.0 + 0.5) AND f.frame_idx < floor(w.end_ms / 50.0 + 0.5) GROUP BY 1, 2),
v AS (SELECT call_id, voice, n AS words, round(COALESCE(fr, 0) * 0.05, 6) AS speech_s, floor(100 * pow(2, {_NR.format(v="st", p=0.5)} / 12) + 0.5) AS pitch_hz, floor(({_NR.format(v="st", p=0.9)} - {_NR.format(v="st", p=0.1)}) * 10 + 0.5) / 10 AS pitch_range_st,
 floor(sd * 10 + 0.5) / 10 AS loudness_sd_db, CASE WHEN span > 2 THEN floor((n - fl) / greatest(0.5, span - pause) * 60 + 0.5) END AS articulation_wpm, floor(pause / greatest(span, 1) * 100 + 0.5) / 100 AS pause_ratio, lp AS long_pauses, floor(fl / greatest(span, 1) * 60 * 10 + 0.5) / 10 AS fillers_per_min, fl AS filler_count
FROM b LEFT JOIN f USING (call_id, voice))
"""


@q("a25_voice_measurements", f"{VOICES} SELECT * FROM v", ("words_v", "frames_v"))
def voice_measurements(spark, d):
    return rounded(voice_rows(spark, d), 6)


def with_signal(df):
    return df.withColumns({
        "snr_db": F.when(F.col("call_id") % 6 != 0, F.lit(10.0) + F.col("call_id") % 30), "band_limited": F.col("call_id") % 8 == 3,
        "clipping_ratio": (F.col("call_id") % 10) / 1000.0, "dynamics_compressed": F.col("call_id") % 9 == 2})


_S = r"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '')"


@q("t18_delivery", f"""{VOICES},
s AS (SELECT v.*, CASE WHEN call_id % 6 <> 0 THEN 10.0 + call_id % 30 END AS snr, call_id % 8 = 3 AS band, (call_id % 10) / 1000.0 AS clip, call_id % 9 = 2 AS comp FROM v),
c AS (SELECT *, list_filter([CASE WHEN articulation_wpm >= {V.FAST_WPM} THEN 'fast' END, CASE WHEN articulation_wpm <= {V.SLOW_WPM} THEN 'slow' END,
  CASE WHEN fillers_per_min >= {V.HESITANT_FILLERS_PER_MIN} OR (pause_ratio >= {V.HESITANT_PAUSE_RATIO} AND long_pauses >= {V.LONG_PAUSE_COUNT}) THEN 'hesitant' WHEN long_pauses >= {V.LONG_PAUSE_COUNT} THEN 'long_pauses' END,
  CASE WHEN pitch_range_st >= {V.WIDE_ST} THEN 'wide_pitch' END, CASE WHEN pitch_range_st <= {V.NARROW_ST} THEN 'narrow_pitch' END,
  CASE WHEN NOT comp AND snr >= {V.MIN_LOUDNESS_SNR_DB} AND loudness_sd_db >= {V.SWING_DB} THEN 'loudness_swings' END,
  CASE WHEN NOT comp AND snr >= {V.MIN_LOUDNESS_SNR_DB} AND loudness_sd_db <= {V.STEADY_DB} THEN 'steady_loudness' END], lambda x: x IS NOT NULL) AS ids FROM s),
u AS (SELECT *, len(list_filter(ids, lambda x: x IN ('fast', 'wide_pitch', 'loudness_swings'))) AS up, len(list_filter(ids, lambda x: x IN ('slow', 'narrow_pitch', 'steady_loudness'))) AS down FROM c),
a AS (SELECT *, CASE WHEN speech_s < {V.MIN_TONE_SPEECH_S} OR snr IS NULL OR snr < {V.MIN_TONE_SNR_DB} THEN 'unclear' WHEN up - down >= 2 AND down = 0 THEN 'high' WHEN up - down <= -2 AND up = 0 THEN 'low' WHEN up = 0 AND down = 0 THEN 'medium' ELSE 'unclear' END AS arousal,
  COALESCE(snr >= {V.MIN_TONE_SNR_DB} AND NOT band AND clip < {V.CLIPPING_RATIO}, false) AS clean FROM u)
SELECT call_id, voice, array_to_string(ids, ',') AS cues, array_to_string(list_transform(ids, lambda x: CASE x WHEN 'fast' THEN 'fast speech (' || {_S.format(c="articulation_wpm")} || ' words per minute)' WHEN 'slow' THEN 'slow speech (' || {_S.format(c="articulation_wpm")} || ' words per minute)'
  WHEN 'hesitant' THEN 'hesitant delivery (' || {_S.format(c="fillers_per_min")} || ' fillers/min, ' || CAST(floor(pause_ratio * 100 + 0.5) AS BIGINT) || '% of the time in pauses)' WHEN 'long_pauses' THEN long_pauses || ' long pauses'
  WHEN 'wide_pitch' THEN 'wide pitch movement (' || {_S.format(c="pitch_range_st")} || ' semitones)' WHEN 'narrow_pitch' THEN 'narrow pitch movement (' || {_S.format(c="pitch_range_st")} || ' semitones)'
  WHEN 'loudness_swings' THEN 'large loudness swings (' || {_S.format(c="loudness_sd_db")} || ' dB)' ELSE 'very steady loudness (' || {_S.format(c="loudness_sd_db")} || ' dB)' END), '; ') AS cue_texts, arousal,
 CASE WHEN arousal <> 'unclear' AND clean AND abs(up - down) >= 2 AND speech_s >= {V.MEDIUM_CONFIDENCE_SPEECH_S} THEN 'medium' ELSE 'low' END AS voice_confidence,
 CASE WHEN speech_s < {V.MIN_TONE_SPEECH_S} THEN 'Only ' || CAST(floor(speech_s + 0.5) AS BIGINT) || ' s of clear speech from this speaker; too little to judge how it sounds.'
  WHEN snr IS NULL OR snr < {V.MIN_TONE_SNR_DB} THEN 'The recording is too noisy (or could not be measured) to judge how the voice sounds.' WHEN arousal = 'high' THEN up || ' cues agree on an animated delivery.' WHEN arousal = 'low' THEN down || ' cues agree on a subdued delivery.'
  WHEN arousal = 'medium' THEN 'Rate, pitch movement and loudness are all in the ordinary range.' ELSE 'The delivery cues point in different directions, so no activation level is claimed.' END
  || CASE WHEN arousal <> 'unclear' AND NOT clean THEN ' The recording is noisy or band-limited, which distorts pitch and loudness, so this is a weak indication.' ELSE '' END AS reason FROM a
""", ("words_v", "frames_v"))
def delivery(spark, d):
    out = O.judge_delivery(with_signal(voice_rows(spark, d)))
    return out.select("call_id", "voice", F.array_join("cues", ",").alias("cues"), F.array_join("cue_texts", "; ").alias("cue_texts"), "arousal", "voice_confidence", "reason")


TONE_CASES = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'angry' WHEN 1 THEN 'calm' WHEN 2 THEN 'confused' WHEN 3 THEN 'nervous' WHEN 4 THEN 'neutral' WHEN 5 THEN 'relieved' WHEN 6 THEN 'embarrassed' END AS emotion,
 CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS intensity, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'unclear' END AS arousal, event_id % 7 = 0 AS hes, CASE WHEN event_id % 2 = 0 THEN 'medium' ELSE 'low' END AS vconf FROM events"""


@q("t19_tone", f"""
WITH c AS (SELECT *, COALESCE(emotion NOT IN ('not_evident', 'unclear', 'neutral'), false) AS wc, COALESCE(arousal <> 'unclear', false) AS vc, COALESCE(emotion IN ('frustrated', 'angry', 'impatient', 'rushed', 'nervous'), false) AS hi, COALESCE(emotion IN ('calm', 'relieved'), false) AS ca FROM ({TONE_CASES}) t),
a AS (SELECT *, CASE WHEN NOT wc AND NOT vc THEN 'insufficient' WHEN wc AND NOT vc THEN 'words_only' WHEN NOT wc THEN 'voice_only' WHEN (hi AND (arousal = 'high' OR (emotion = 'nervous' AND hes))) OR (ca AND arousal <> 'high') OR (emotion = 'confused' AND (hes OR arousal = 'low')) THEN 'agree'
  WHEN (hi AND arousal = 'low') OR (ca AND arousal = 'high') THEN 'differ' ELSE 'words_only' END AS agreement FROM c)
SELECT event_id, agreement, CASE agreement WHEN 'insufficient' THEN 'not evident' WHEN 'voice_only' THEN CASE WHEN arousal = 'high' THEN 'animated delivery' WHEN arousal = 'low' THEN 'subdued delivery' WHEN hes THEN 'hesitant delivery' ELSE 'even delivery' END
 WHEN 'differ' THEN 'mixed signals: wording suggests ' || emotion || ', delivery sounds ' || CASE WHEN arousal = 'low' THEN 'subdued' ELSE 'animated' END ELSE emotion END AS tone_label, CASE WHEN agreement = 'agree' AND vconf = 'medium' AND intensity <> 'low' THEN 'medium' ELSE 'low' END AS tone_confidence FROM a
""")
def tone(spark, d):
    rows = table(spark, d, "events").selectExpr(
        "event_id", "CASE event_id % 8 WHEN 0 THEN 'angry' WHEN 1 THEN 'calm' WHEN 2 THEN 'confused' WHEN 3 THEN 'nervous' WHEN 4 THEN 'neutral' WHEN 5 THEN 'relieved' WHEN 6 THEN 'embarrassed' END AS emotion",
        "CASE event_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'medium' END AS intensity", "CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'unclear' END AS arousal",
        "CASE WHEN event_id % 7 = 0 THEN array('hesitant') ELSE array() END AS cues", "CASE WHEN event_id % 2 = 0 THEN 'medium' ELSE 'low' END AS voice_confidence")
    return O.compose_tone(rows).select("event_id", "agreement", "tone_label", "tone_confidence")


# ------------------------------------------------------------------------- audio


def recordings(spark, d):
    """One 16-bit WAV per embedding: the vector is one period of a tone, followed by near-silence."""

    def render(batches):
        for b in (whole.iloc[at:at + CLIPS] for whole in batches for at in range(0, len(whole), CLIPS)):
            out = []
            for vid, vec in zip(b["vec_id"], b["embedding"]):
                rate = 16000 if vid % 2 else 8000
                wave = np.tile(np.asarray(vec, dtype=np.float64), rate // len(vec))
                wave = wave / max(1e-9, np.abs(wave).max()) * (1.0 if vid % 5 == 0 else 0.4)
                wave[len(wave) * 2 // 3:] *= 0.01 * (1 + vid % 4)
                pcm = np.clip(np.round(wave * 32767), -32768, 32767).astype("<i2").tobytes()
                head = b"RIFF" + (36 + len(pcm)).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + (1).to_bytes(2, "little") + (1).to_bytes(2, "little")
                head += rate.to_bytes(4, "little") + (rate * 2).to_bytes(4, "little") + (2).to_bytes(2, "little") + (16).to_bytes(2, "little") + b"data" + len(pcm).to_bytes(4, "little")
                out.append((f"/recordings/clip-{vid}.wav", head + pcm))
            yield pd.DataFrame(out, columns=["path", "content"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(render, "path string, content binary")


@q("s08_audio_catalog", """
SELECT 'clip-' || vec_id || '.wav' AS id, 'wav' AS kind, 44 + 2 * (rate // 64) * 64 AS bytes, floor((2 * (rate // 64) * 64) / (2.0 * rate) * 10 + 0.5) / 10 AS duration_s FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 16000 ELSE 8000 END AS rate FROM embeddings) e
""")
def audio_catalog(spark, d):
    return audio.catalog(recordings(spark, d))


@q("s09_audio_frames")
def audio_frames(spark, d):
    frames = audio.audio_frames(recordings(spark, d))
    voiced = (F.col("f0") > 0) & (F.col("db") > F.col("floor_db") + V.VOICED_ABOVE_FLOOR_DB)
    return frames.groupBy("path").agg(F.count("*").alias("frames"), F.count_if(voiced).alias("voiced"), F.round(F.max("floor_db"), 2).alias("floor_db"), F.round(F.avg(F.element_at("cep", 1)), 3).alias("first_cepstrum"))


@q("a26_t20_signal_quality")
def signal_quality(spark, d):
    out = audio.signal_quality(audio.signal_frames(recordings(spark, d)))
    return out.select("*", F.col("condition.label").alias("label"), F.array_join("condition.flags", ",").alias("flags")).drop("condition")


@q("t20_condition", """
SELECT event_id, CASE WHEN n = 0 THEN CASE WHEN snr >= 30 THEN 'clean_wideband' ELSE 'acceptable' END WHEN n > 1 THEN 'degraded' WHEN snr < 26 THEN 'noisy' WHEN bl THEN 'band_limited' WHEN cl THEN 'clipped' ELSE 'compressed' END AS label, n AS n_flags
FROM (SELECT *, CAST(snr < 26 AS INT) + CAST(bl AS INT) + CAST(cl AS INT) + CAST(co AS INT) AS n FROM (SELECT event_id, (event_id % 50) * 1.0 AS snr, event_id % 6 = 1 AS bl, event_id % 10 > 5 AS cl, event_id % 9 = 2 AS co FROM events) a) b
""")
def condition(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "(event_id % 50) * 1.0D AS snr_db", "event_id % 6 = 1 AS band_limited", "(event_id % 10) / 1000.0D AS clipping_ratio", "event_id % 9 = 2 AS dynamics_compressed")
    return rows.select("event_id", audio.condition().alias("c")).select("event_id", "c.label", F.size("c.flags").alias("n_flags"))


@q("a28_envelope", """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value - 5 AS v FROM events), n AS (SELECT user_id, greatest(1, count(*) // 12) AS size FROM e GROUP BY 1),
b AS (SELECT e.user_id, i // size AS bucket, max(abs(v)) AS peak FROM e JOIN n USING (user_id) WHERE i // size < 12 AND (i - (i // size) * size) % greatest(1, size // 40) = 0 GROUP BY 1, 2)
SELECT user_id, bucket, round(greatest(0.06, peak / CASE WHEN max(peak) OVER (PARTITION BY user_id) = 0 THEN 1 ELSE max(peak) OVER (PARTITION BY user_id) END), 9) AS height FROM b
""")
def envelope(spark, d):
    from callgrain.functions.columns import micros
    from callgrain.operators.sequence import running_sum

    rows = table(spark, d, "events").select("user_id", "event_id", micros("ts").alias("us"), (F.col("value") - 5).alias("v")).withColumn("day", F.expr("us div 86400000000"))
    placed = running_sum(rows, key=["user_id"], chunk="day", order=["us", "event_id"], sums={"i": F.lit(1).cast("bigint")}).withColumn("i", F.col("i") - 1)
    return rounded(audio.envelope(placed, key="user_id", position="i", value="v", buckets=12))


# ----------------------------------------------------------------------- findings


def wide_rows(spark, d):
    w = settle(acted_words_view(spark, d))
    t = settle(C.turns(w))
    b = settle(C.boundaries(t))
    metrics = C.speech_metrics(w, t, b).drop("speakers", "duration_s")
    ordered = F.array_sort(F.collect_list(F.struct("at", "turn_id")))
    cuts = b.where("kind = 'interruption'").groupBy("call_id").agg(F.transform(ordered, lambda x: x["at"]).alias("cut_at"))
    sims = b.groupBy("call_id").agg(F.count_if(F.col("kind") == "simultaneous").alias("simultaneous_n"))
    unsure = t.groupBy("call_id").agg(F.count_if("uncertain").alias("uncertain_turns"))
    speakers = C.speaker_counts(w)
    seen = C.overlap_visibility(b, speakers)
    joined = metrics.join(cuts, "call_id", "left").join(sims, "call_id", "left").join(unsure, "call_id", "left").join(speakers, "call_id", "left").join(seen, "call_id", "left")
    return with_signal(joined).withColumns({
        "speakers": F.col("speakers").cast("int"), "stt_provider": F.lit("deepgram"), "source": F.when(F.col("call_id") % 3 == 0, "acoustic").otherwise("recognizer"),
        "reliable": F.col("call_id") % 3 == 0, "noise_floor_db": F.lit(-50.0), "level_sd_db": F.lit(3.2), "sample_rate": F.lit(8000), "hf_ratio_db": F.lit(None).cast("double"),
        "understood": F.col("call_id") % 4 != 0, "intents": F.when(F.col("call_id") % 5 == 0, F.array(F.lit("refund_request"), F.lit("missing_order"))).otherwise(F.array(F.lit("other"))),
        "intent_confidence": F.when(F.col("call_id") % 6 == 1, "low").otherwise("high"), "dropped_unverified": (F.col("call_id") % 3).cast("bigint")})


#: Findings of each call in order: [id, severity, area, title], null where a rule does not hold.
FOUND = f"""
WITH m AS ({METRICS}),
b AS (SELECT call_id, count(*) FILTER (WHERE kind = 'interruption') AS cuts, count(*) FILTER (WHERE kind = 'simultaneous') AS sims FROM boundaries_v GROUP BY 1),
u AS (SELECT call_id, count(*) FILTER (WHERE confidence < 0.6) AS unsure FROM acted_turns_v GROUP BY 1),
w AS (SELECT m.*, COALESCE(cuts, 0) AS cuts, COALESCE(sims, 0) AS sims, COALESCE(unsure, 0) AS unsure, CASE WHEN call_id % 6 <> 0 THEN 10.0 + call_id % 30 END AS snr,
  len(string_split(NULLIF(low_confidence_words, ''), '|')) AS unclear, call_id % 3 = 0 AS reliable, call_id % 4 <> 0 AS understood FROM m LEFT JOIN b USING (call_id) LEFT JOIN u USING (call_id)),
f AS (SELECT call_id, list_filter([
  CASE WHEN snr < 12 THEN ['noise_heavy', 'issue', 'audio', 'Heavy background noise'] END, CASE WHEN snr >= 12 AND snr < 26 THEN ['noise', 'warn', 'audio', 'Background noise'] END,
  CASE WHEN snr IS NOT NULL AND call_id % 8 = 3 THEN ['band_limited', 'warn', 'audio', 'Limited bandwidth (phone-like, muffled or low-rate audio)'] END,
  CASE WHEN snr IS NOT NULL AND call_id % 9 = 2 THEN ['compressed', 'info', 'audio', ''] END, CASE WHEN snr IS NOT NULL AND (call_id % 10) / 1000.0 > 0.005 THEN ['clipping', 'warn', 'audio', 'Audio clipping'] END,
  CASE WHEN snr IS NULL AND low_confidence_ratio >= 0.1 THEN ['noise', 'warn', 'audio', 'Degraded audio'] END, CASE WHEN avg_confidence < 0.85 THEN ['stt_low', 'issue', 'speech', 'Low transcription confidence'] END,
  CASE WHEN avg_confidence >= 0.85 AND (avg_confidence < 0.95 OR unclear >= 3) THEN ['stt_reduced', 'warn', 'speech', 'Reduced transcription confidence'] END,
  CASE WHEN filler_count >= 8 THEN ['hesitation_heavy', 'warn', 'speech', 'Very hesitant speech'] WHEN filler_count >= 3 THEN ['hesitation', 'warn', 'speech', 'Hesitant speech'] END,
  CASE WHEN long_pause_count >= 1 THEN ['long_pauses', 'warn', 'speech', 'Long pauses'] WHEN pause_count >= 4 THEN ['pauses', 'info', 'speech', ''] END,
  CASE WHEN words_per_minute > 185 THEN ['fast', 'warn', 'speech', 'Fast speech'] WHEN words_per_minute < 105 THEN ['slow', 'info', 'speech', ''] END,
  CASE WHEN speakers >= 2 THEN ['speakers', 'info', 'conversation', ''] END, CASE WHEN NOT reliable THEN ['attribution_uncertain', 'warn', 'conversation', 'Who said what is uncertain'] END,
  CASE WHEN reliable AND unsure > 0 AND speakers >= 2 THEN ['attribution_partial', 'info', 'conversation', ''] END, CASE WHEN sims > 0 OR cuts > 0 THEN ['overlap', 'warn', 'conversation', 'Interruptions'] END,
  CASE WHEN speakers > 1 AND sims = 0 THEN ['overlap_limited', 'info', 'conversation', ''] END, CASE WHEN understood AND call_id % 5 = 0 THEN ['two_intents', 'info', 'content', ''] END,
  CASE WHEN understood AND call_id % 6 = 1 THEN ['intent_unclear', 'warn', 'content', 'Intent is unclear'] END, CASE WHEN understood AND call_id % 3 > 0 THEN ['ungrounded', 'info', 'content', ''] END
 ], lambda x: x IS NOT NULL) AS found FROM w)
"""


@q("t21_a27_findings", f"""{FOUND},
s AS (SELECT *, COALESCE(list_sum(list_transform(found, lambda x: CASE x[2] {" ".join(f"WHEN '{k}' THEN {v}" for k, v in V.SEVERITY_WEIGHT.items())} ELSE 0 END)), 0) AS score FROM f)
SELECT call_id, array_to_string(list_transform(found, lambda x: x[1]), ',') AS ids, score, CASE WHEN score < 2 THEN 'Easy' WHEN score < 5 THEN 'Moderate' WHEN score < 9 THEN 'Hard' ELSE 'Severe' END AS label,
 array_to_string(list_transform(list_filter(found, lambda x: x[2] <> 'info'), lambda x: x[4])[1:3], ' | ') AS notable FROM s
""", ("acted_v", "acted_turns_v", "boundaries_v"))
def call_findings(spark, d):
    out = findings.with_findings(wide_rows(spark, d))
    diff = findings.difficulty(F.col("findings"))
    return out.select("call_id", F.array_join(F.transform("findings", lambda f: f["id"]), ",").alias("ids"), diff["score"].alias("score"), diff["label"].alias("label"), F.array_join(findings.notable(F.col("findings")), " | ").alias("notable"))


@q("a33_findings_per_area", f"{FOUND} SELECT x[3] AS area, x[1] AS id, x[2] AS severity, count(*) AS n FROM (SELECT unnest(found) AS x FROM f) u GROUP BY ALL", ("acted_v", "acted_turns_v", "boundaries_v"))
def findings_per_area(spark, d):
    return findings.per_area(findings.with_findings(wide_rows(spark, d)))


SIMPLE_FINDINGS = """SELECT id, [x FOR x IN [CASE WHEN snr < 12 THEN 'noise_heavy:3' WHEN snr < 26 THEN 'noise:2' END, CASE WHEN id % 8 = 3 THEN 'band_limited:2' END, CASE WHEN id % 9 = 2 THEN 'compressed:0.5' END, CASE WHEN id % 10 > 5 THEN 'clipping:2' END,
 CASE WHEN fl >= 8 THEN 'hesitation_heavy:2' WHEN fl >= 3 THEN 'hesitation:2' END, CASE WHEN lp >= 1 THEN 'long_pauses:2' WHEN pc >= 4 THEN 'pauses:0.5' END, CASE WHEN wpm > 185 THEN 'fast:2' WHEN wpm < 105 THEN 'slow:0.5' END] IF x IS NOT NULL] AS f
 FROM (SELECT id, 5.0 + id % 30 AS snr, id % 12 AS fl, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END AS lp, id % 6 AS pc, 90 + id % 110 AS wpm FROM calls_v) c"""


@q("t21_a27_ledger_findings", f"""
WITH x AS ({SIMPLE_FINDINGS}), s AS (SELECT id, f, COALESCE(list_sum(list_transform(f, lambda y: CAST(split_part(y, ':', 2) AS DOUBLE))), 0) AS score FROM x)
SELECT id, array_to_string(list_transform(f, lambda y: split_part(y, ':', 1)), ',') AS ids, score, CASE WHEN score < 2 THEN 'Easy' WHEN score < 5 THEN 'Moderate' WHEN score < 9 THEN 'Hard' ELSE 'Severe' END AS label FROM s
""", ("calls_v",))
def ledger_findings(spark, d):
    rows = calls_view(spark, d).selectExpr(
        "id", "5.0D + id % 30 AS snr_db", "-50.0D AS noise_floor_db", "id % 8 = 3 AS band_limited", "id % 9 = 2 AS dynamics_compressed", "(id % 10) / 1000.0D AS clipping_ratio", "3.2D AS level_sd_db", "8000 AS sample_rate",
        "id % 12 AS filler_count", "CASE WHEN id % 7 = 0 THEN 1L ELSE 0L END AS long_pause_count", "id % 6 AS pause_count", "90 + id % 110 AS words_per_minute", "2.5D AS longest_pause_s")
    out = findings.with_findings(rows)
    diff = findings.difficulty(F.col("findings"))
    return out.select("id", F.array_join(F.transform("findings", lambda f: f["id"]), ",").alias("ids"), diff["score"].alias("score"), diff["label"].alias("label"))


# --------------------------------------------------------------------- evaluation


def labelled_documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")


def document_checks():
    note = F.concat(F.lit("doc "), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    return {
        "Quality: long documents are good": (F.when(F.col("n_chars") > 800, F.col("quality") == 1), note),
        "Toxic: clean text": (F.col("toxic") == 0, note), "Length: not empty": (F.col("n_chars") > 0, None)}


CELLS = """SELECT 'Quality: long documents are good' AS name, quality = 1 AS ok, doc_id, lang, true AS noted FROM documents JOIN labels USING (doc_id) WHERE n_chars > 800
 UNION ALL SELECT 'Toxic: clean text', toxic = 0, doc_id, lang, true FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'Length: not empty', n_chars > 0, doc_id, lang, false FROM documents JOIN labels USING (doc_id)"""
CHECKS = f"""SELECT name, count(*) FILTER (WHERE ok) AS ok, count(*) AS total, CAST(floor(100.0 * count(*) FILTER (WHERE ok) / count(*) + 0.5) AS BIGINT) AS pct FROM ({CELLS}) x GROUP BY 1"""


@q("e01_score_matrix", CHECKS)
def score_matrix(spark, d):
    return E.score_matrix(labelled_documents(spark, d), document_checks())


@q("e01_failure_notes", f"""
SELECT DISTINCT name, 'doc ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') AS note FROM ({CELLS}) x WHERE NOT ok AND noted
""")
def failure_notes(spark, d):
    return E.failure_notes(labelled_documents(spark, d), document_checks())


_CELL = "ok || '/' || total || ' (' || pct || '%)'"
_SIDE = """SELECT name, count(*) FILTER (WHERE ok) AS ok, count(*) AS total, CAST(floor(100.0 * count(*) FILTER (WHERE ok) / count(*) + 0.5) AS BIGINT) AS pct FROM ({cells}) x WHERE lang {op} 'en' GROUP BY 1"""
_MATRIX = f"""SELECT 'Documents' AS category, name AS measure, coalesce(max(live), 'n/a') AS live, coalesce(max(offline), 'n/a') AS offline, coalesce(max(failures), 'none') AS failures FROM (
 SELECT name, {_CELL} AS live, NULL AS offline, CASE WHEN ok < total THEN (total - ok) || ' failed' END AS failures FROM ({_SIDE.format(cells=CELLS, op="=")}) a
 UNION ALL SELECT name, NULL, {_CELL}, CASE WHEN ok < total THEN (total - ok) || ' failed' END FROM ({_SIDE.format(cells=CELLS, op="<>")}) b) c GROUP BY name"""


def document_matrix(spark, d):
    """English documents stand for the live source, all others for the offline one."""
    docs = labelled_documents(spark, d)
    scores = lambda rows: E.score_matrix(rows, document_checks())
    return E.assemble_matrix(E.matrix_rows(scores(docs.where("lang = 'en'")), "Documents", "live"), E.matrix_rows(scores(docs.where("lang <> 'en'")), "Documents", "offline"))


@q("e12_s11_matrix", _MATRIX)
def matrix(spark, d):
    return document_matrix(spark, d)


@q("s11_markdown_lines", f"""
SELECT '| Category | Measure | Live | Offline | Failures |' AS line UNION ALL SELECT '| --- | --- | --- | --- | --- |'
UNION ALL SELECT '| ' || category || ' | ' || measure || ' | ' || live || ' | ' || offline || ' | ' || failures || ' |' FROM ({_MATRIX}) m
""")
def markdown_lines(spark, d):
    folder = work_dir(spark, "matrix")
    sinks.write_markdown(document_matrix(spark, d), folder)
    return spark.read.text(folder).withColumnRenamed("value", "line")


@q("e02_entity_checks", """
WITH x AS (SELECT event_id, [regexp_replace(CAST(event_id % 1000 AS VARCHAR), '^0+', ''), CAST(user_id AS VARCHAR), 'abc', CAST(4000 + event_id % 7 AS VARCHAR)] AS heard, [CAST(user_id AS VARCHAR), CASE WHEN event_id % 4 = 0 THEN '77777' ELSE CAST(event_id % 1000 AS VARCHAR) END] AS wanted, ['4001'] AS allowed FROM events),
y AS (SELECT event_id, list_transform(heard, lambda h: regexp_replace(h, '^0+', '')) AS heard, list_transform(wanted, lambda w: regexp_replace(w, '^0+', '')) AS wanted, allowed FROM x)
SELECT event_id, array_to_string(list_sort(list_distinct(list_filter(wanted, lambda w: NOT list_contains(heard, w)))), ',') AS missing,
 array_to_string(list_filter(heard, lambda h: regexp_full_match(h, '\\d{2,}') AND NOT list_contains(allowed, h) AND len(list_filter(wanted, lambda w: contains(w, h) OR contains(h, w))) = 0), ',') AS stray FROM y
""")
def entity_checks(spark, d):
    s = lambda c: c.cast("string")
    e = F.col("event_id")
    rows = table(spark, d, "events").select(
        "event_id", E.strip_zeros(F.array(s(e % 1000), s(F.col("user_id")), F.lit("abc"), s(4000 + e % 7))).alias("heard"),
        E.strip_zeros(F.array(s(F.col("user_id")), F.when(e % 4 == 0, "77777").otherwise(s(e % 1000)))).alias("wanted"), F.array(F.lit("4001")).alias("allowed"))
    return rows.select(
        "event_id", F.array_join(F.array_sort(E.missing_values(F.col("heard"), F.col("wanted"))), ",").alias("missing"),
        F.array_join(E.stray_values(F.col("heard"), F.col("wanted"), F.col("allowed")), ",").alias("stray"))


@q("e03_correction_hits", """
SELECT event_id, (contains('40', o) OR contains(o, '40')) AND (contains(CAST(48 + event_id % 3 AS VARCHAR), '48') OR contains('48', CAST(48 + event_id % 3 AS VARCHAR))) AS hit FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '40' WHEN 1 THEN '4' ELSE '75' END AS o FROM events) e
""")
def correction_hits(spark, d):
    e = F.col("event_id")
    found = F.array(F.struct(F.when(e % 3 == 0, "40").when(e % 3 == 1, "4").otherwise("75").alias("original"), (48 + e % 3).cast("string").alias("corrected")))
    return table(spark, d, "events").select("event_id", E.correction_hit(found, F.lit("40"), F.lit("48")).alias("hit"))


@q("e05_truth_events", """
WITH l AS (SELECT call_id, turn, who, CASE WHEN turn % 3 = 1 THEN start_ms - 900 ELSE start_ms END AS s, end_ms AS e, turn % 5 = 2 AS cut FROM (SELECT call_id, turn, min(speaker) AS who, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words_v GROUP BY 1, 2) x),
n AS (SELECT *, lag(who) OVER w AS pw, lag(e) OVER w AS pe, lead(who) OVER w AS nw, lead(s) OVER w AS ns FROM l WINDOW w AS (PARTITION BY call_id ORDER BY turn))
SELECT call_id, turn, s AS at, 'simultaneous' AS kind FROM n WHERE who <> pw AND s < pe - 50 UNION ALL SELECT call_id, turn, ns, 'interruption' FROM n WHERE cut AND nw <> who
""", ("words_v",))
def truth_events(spark, d):
    lines = words_view(spark, d).groupBy("call_id", "turn").agg(F.min("chunk").alias("chunk"), F.min("speaker").alias("who"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    lines = lines.withColumns({"start_ms": F.when(F.col("turn") % 3 == 1, F.col("start_ms") - 900).otherwise(F.col("start_ms")), "text": F.when(F.col("turn") % 5 == 2, "and then —").otherwise("done.")})
    return E.truth_events(lines)


@q("e06_interruption_scores", f"""
WITH RECURSIVE l AS (SELECT call_id, turn, arg_min(speaker, pos) AS who, min(start_ms) AS s, max(end_ms) AS e FROM acted_v GROUP BY 1, 2),
n AS (SELECT *, lag(who) OVER w AS pw, lag(e) OVER w AS pe, lead(who) OVER w AS nw, lead(s) OVER w AS ns FROM l WINDOW w AS (PARTITION BY call_id ORDER BY turn)),
ev AS (SELECT call_id AS owner_id, s AS us, 'simultaneous' AS kind FROM n WHERE who <> pw AND s < pe - 50 UNION ALL SELECT call_id, ns, 'interruption' FROM n WHERE turn % 4 = 0 AND nw <> who),
f AS (SELECT call_id AS owner_id, CAST(trunc(floor(start_ms / 1000.0 * 100 + 0.5) / 100 * 1000) AS BIGINT) AS us, kind FROM boundaries_v WHERE kind IN ('simultaneous', 'interruption')),
t AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY us, kind) AS rn FROM ev),
d AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY us, kind) AS pos FROM f),
{FIRST_FIT.format(tolerance=1500)}
{SCORES.replace("*", "c.* EXCLUDE (owner_id), owner_id AS call_id", 1)}
""", ("acted_v", "boundaries_v"))
def interruption_scores(spark, d):
    """Detected boundaries against the scripted early starts of the same lines."""
    w = acted_words_view(spark, d)
    found = C.boundaries(settle(C.turns(w))).where("kind IN ('simultaneous', 'interruption')").select("call_id", (F.col("at") * 1000).cast("bigint").alias("at"), "kind")
    lines = w.groupBy("call_id", "turn").agg(F.min("chunk").alias("chunk"), F.min_by("speaker", "pos").alias("who"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    scripted = E.truth_events(lines.withColumn("text", F.when(F.col("turn") % 4 == 0, "and —").otherwise("done."))).select("call_id", "at", "kind")
    return rounded(I.detection_scores(I.match_events(scripted, found, key="call_id", tolerance=1500, span=600_000), ["call_id"]))


@q("e08_condition_flags", """
WITH p AS (SELECT event_id AS id, event_id % 2 = 0 AS noisy, event_id % 3 = 0 AS clipped, event_id % 5 = 0 AS compressed FROM events), t AS (SELECT event_id AS id, CASE WHEN event_id % 7 <> 0 THEN event_id % 4 = 0 END AS noisy, CASE WHEN event_id % 11 = 0 THEN true END AS clipped, event_id % 5 < 2 AS compressed FROM events),
l AS (SELECT 'noisy' AS flag, t.noisy AS e, p.noisy AS g FROM p JOIN t USING (id) UNION ALL SELECT 'clipped', t.clipped, p.clipped FROM p JOIN t USING (id) UNION ALL SELECT 'compressed', t.compressed, p.compressed FROM p JOIN t USING (id))
SELECT flag, count(*) FILTER (WHERE e = g) AS right_n, count(*) AS checks FROM l WHERE e IS NOT NULL GROUP BY 1
""")
def condition_flags(spark, d):
    ev = table(spark, d, "events")
    got = ev.selectExpr("event_id AS id", "event_id % 2 = 0 AS noisy", "event_id % 3 = 0 AS clipped", "event_id % 5 = 0 AS compressed")
    truth = ev.selectExpr("event_id AS id", "CASE WHEN event_id % 7 <> 0 THEN event_id % 4 = 0 END AS noisy", "CASE WHEN event_id % 11 = 0 THEN true END AS clipped", "event_id % 5 < 2 AS compressed")
    return E.flag_scores(got, truth, ["noisy", "clipped", "compressed"])


@q("e10_healthy_share", "SELECT input_source, count(*) FILTER (WHERE status = 'completed' AND predicted_category = 'ok' AND id % 8 <> 0) AS ok, count(*) AS total, round(count(*) FILTER (WHERE status = 'completed' AND predicted_category = 'ok' AND id % 8 <> 0) / count(*), 9) AS share FROM calls_v GROUP BY 1", ("calls_v",))
def healthy_share(spark, d):
    fine = (F.col("status") == "completed") & (F.col("predicted_category") == "ok") & (F.col("id") % 8 != 0)
    n = F.count_if(F.coalesce(fine, F.lit(False)))
    return calls_view(spark, d).groupBy("input_source").agg(n.alias("ok"), F.count("*").alias("total"), F.round(ratio(n, F.count("*")), 9).alias("share"))


@q("e11_finding_checks", f"""
WITH x AS ({SIMPLE_FINDINGS}), y AS (SELECT id, list_transform(f, lambda v: split_part(v, ':', 1)) AS ids FROM x)
SELECT sum(CAST(list_contains(ids, 'noise') AS INT) + CAST(list_contains(ids, 'fast') AS INT))::BIGINT AS present, (2 * count(*))::BIGINT AS expected, sum(1 - CAST(list_contains(ids, 'clipping') AS INT))::BIGINT AS quiet, count(*) AS forbidden FROM y
""", ("calls_v",))
def finding_checks(spark, d):
    ids = F.split("ids", ",")
    c = E.finding_checks(ids, F.array(F.lit("noise"), F.lit("fast")), F.array(F.lit("clipping")))
    return ledger_findings(spark, d).select(c.alias("c")).agg(*[F.sum(f"c.{k}").alias(k) for k in ("present", "expected", "quiet", "forbidden")])


@q("t24_customer_voice_rows", f"""{VOICES},
c AS (SELECT call_id, speakers, COALESCE(CASE call_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END, CASE WHEN speakers <= 1 THEN 0 END) AS want FROM (SELECT call_id, count(DISTINCT speaker) AS speakers FROM words_v GROUP BY 1) x),
l AS (SELECT call_id, count(*) AS n, min(voice) AS lone FROM v GROUP BY 1),
p AS (SELECT c.call_id, CASE WHEN x.call_id IS NOT NULL THEN want WHEN n = 1 AND speakers <= 1 THEN lone END AS voice FROM c LEFT JOIN l USING (call_id) LEFT JOIN v x ON x.call_id = c.call_id AND x.voice = c.want)
SELECT call_id, voice, words, round(articulation_wpm, 6) AS articulation_wpm FROM v JOIN p USING (call_id, voice)
""", ("words_v", "frames_v"))
def customer_voice_rows(spark, d):
    calls = C.speaker_counts(words_view(spark, d)).withColumn("customer_speaker", F.when(F.col("call_id") % 3 == 0, 1).when(F.col("call_id") % 3 == 1, 0))
    return rounded(O.customer_voice_rows(voice_rows(spark, d), calls).select("call_id", "voice", "words", "articulation_wpm"), 6)
