"""Words, phrases, turns, boundaries and speech metrics of the conversation table."""

from __future__ import annotations

from pyspark.sql import functions as F

from callgrain.functions import predicates as P
from callgrain.operators import conversation as C
from callgrain.operators import intervals as I
from callgrain.plans.ledger import rounded
from callgrain.plans.registry import Catalog
from callgrain.sources import recogniser
from callgrain.sources.settle import settle
from callgrain.sources.views import acted_words_view, frames_view, table, truth_view, words_view

catalog = Catalog()
q = catalog.query


@q("s03_words", "SELECT call_id, turn, pos, word, speaker, start_ms, end_ms, round(confidence, 6) AS confidence FROM words_v", ("words_v",))
def words(spark, d):
    return rounded(words_view(spark, d).drop("chunk"), 6)


@q("s03_flat_documents", """
SELECT CAST(call_id AS VARCHAR) AS call_id, row_number() OVER (PARTITION BY call_id ORDER BY turn, pos) - 1 AS pos, word || '.' AS word,
 CASE WHEN pos % 7 = 3 THEN 0.0 ELSE round(confidence, 6) END AS confidence, CASE WHEN pos % 5 <> 2 THEN start_ms END AS start_ms, CASE WHEN pos % 5 <> 2 THEN end_ms END AS end_ms,
 CASE WHEN turn % 4 <> 1 THEN CASE speaker WHEN 'user' THEN 0 ELSE 1 END END AS speaker FROM words_v
""", ("words_v",))
def flat_documents(spark, d):
    """One recogniser document a call, as JSON text, some fields absent; then parsed and read like files."""
    some = lambda when, value: F.when(when, value)
    w = words_view(spark, d)
    word = F.struct(
        "turn", "pos", "word", F.concat("word", F.lit(".")).alias("punctuated_word"), some(F.col("pos") % 7 != 3, F.col("confidence")).alias("confidence"),
        some(F.col("pos") % 5 != 2, F.col("start_ms") / 1000).alias("start"), some(F.col("pos") % 5 != 2, F.col("end_ms") / 1000).alias("end"),
        some(F.col("turn") % 4 != 1, F.when(F.col("speaker") == "user", 0).otherwise(1)).alias("speaker"))
    docs = w.groupBy(F.col("call_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(word)).alias("words"))
    return rounded(recogniser.words_of(recogniser.parsed(docs.select(F.to_json(F.struct("id", "words")).alias("json")), "json", recogniser.FLAT)).drop("chunk", "turn"), 6)


@q("s06_timeline_documents", """
SELECT CAST(call_id AS VARCHAR) AS call_id, row_number() OVER (PARTITION BY call_id ORDER BY turn) - 1 AS turn, who, 'line ' || turn AS text, start_ms, end_ms
FROM (SELECT call_id, turn, speaker AS who, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM words_v GROUP BY ALL) t
""", ("words_v",))
def timeline_documents(spark, d):
    lines = words_view(spark, d).groupBy("call_id", "turn", F.col("speaker").alias("who")).agg(F.min("start_ms").alias("a"), F.max("end_ms").alias("b"))
    line = F.struct("turn", "who", F.concat(F.lit("line "), F.col("turn").cast("string")).alias("text"), (F.col("a") / 1000).alias("start"), (F.col("b") / 1000).alias("end"))
    docs = lines.groupBy(F.col("call_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(line)).alias("segments"))
    return recogniser.timeline_of(recogniser.parsed(docs.select(F.to_json(F.struct("id", "segments")).alias("json")), "json", recogniser.TIMELINE)).drop("chunk")


@q("s06_truth_lines", "SELECT call_id, turn, who, start_ms, end_ms FROM truth_v", ("truth_v",))
def truth_lines(spark, d):
    return truth_view(spark, d)


@q("s07_script_text", """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS script_plain, CASE WHEN count(DISTINCT role) > 1 THEN string_agg(CASE role WHEN 'agent' THEN 'Agent: ' ELSE 'Customer: ' END || text, chr(10) ORDER BY turn) ELSE string_agg(text, ' ' ORDER BY turn) END AS script_display
FROM (SELECT conv_id, turn, text, CASE role WHEN 'assistant' THEN 'agent' ELSE role END AS role FROM conversations) c GROUP BY 1
""")
def script_text(spark, d):
    lines = table(spark, d, "conversations").withColumn("role", F.when(F.col("role") == "assistant", "agent").otherwise(F.col("role")))
    return C.script_text(lines, key="conv_id", order="turn", role="role", text="text")


@q("f09_recogniser_threshold", """
SELECT call_id, provider, round(avg_confidence, 9) AS avg_confidence, avg_confidence > 0 AND avg_confidence < 0.6 AS below, CASE provider WHEN 'deepgram' THEN 0.85 ELSE 0.6 END AS threshold,
 avg_confidence > 0 AND avg_confidence < CASE provider WHEN 'deepgram' THEN 0.85 ELSE 0.6 END AS bad_stt
FROM (SELECT call_id, CASE WHEN call_id % 2 = 0 THEN 'deepgram' ELSE 'whisper' END AS provider, avg(CASE WHEN call_id % 5 = 0 THEN confidence * 0.75 ELSE confidence END) AS avg_confidence FROM words_v GROUP BY 1) a
""", ("words_v",))
def recogniser_threshold(spark, d):
    conf = F.when(F.col("call_id") % 5 == 0, F.col("confidence") * 0.75).otherwise(F.col("confidence"))
    per_call = words_view(spark, d).groupBy("call_id").agg(F.avg(conf).alias("avg_confidence")).withColumn("provider", F.when(F.col("call_id") % 2 == 0, "deepgram").otherwise("whisper"))
    threshold = P.confidence_threshold("provider")
    c = F.col("avg_confidence")
    return per_call.select("call_id", "provider", F.round(c, 9).alias("avg_confidence"), P.below_threshold(c).alias("below"), threshold.alias("threshold"), ((c > 0) & (c < threshold)).alias("bad_stt"))


@q("w02_word_gaps", """
SELECT call_id, turn, pos, gap_ms, COALESCE(gap_ms > 700, false) AS is_pause, COALESCE(gap_ms > 1500, false) AS is_long_pause FROM
 (SELECT call_id, turn, pos, start_ms - lag(end_ms) OVER (PARTITION BY call_id ORDER BY turn, pos) AS gap_ms FROM words_v) x
""", ("words_v",))
def word_gaps(spark, d):
    return C.word_gaps(words_view(spark, d)).select("call_id", "turn", "pos", "gap_ms", "is_pause", "is_long_pause")


PHRASES = """SELECT *, sum(CASE WHEN pe IS NULL OR start_ms - pe > 250 OR regexp_matches(rtrim(pw), '[.?!]["'')]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY turn, pos)::BIGINT AS phrase_id
 FROM (SELECT *, lag(end_ms) OVER w AS pe, lag(word) OVER w AS pw FROM words_v WINDOW w AS (PARTITION BY call_id ORDER BY turn, pos)) a"""


@q("w03_phrases", f"SELECT call_id, phrase_id, min(start_ms) AS start_ms, arg_max(end_ms, (turn, pos)) AS end_ms, count(*) AS words FROM ({PHRASES}) p GROUP BY 1, 2", ("words_v",))
def phrases(spark, d):
    return C.phrase_spans(C.phrases(words_view(spark, d))).select("call_id", "phrase_id", "start_ms", "end_ms", "words")


@q("w04_turns", "SELECT call_id, turn_id::BIGINT AS turn_id, speaker, start_ms, end_ms, words, text, confidence, confidence < 0.6 AS uncertain FROM turns_v", ("turns_v",))
def turns(spark, d):
    return C.turns(words_view(spark, d)).drop("chunk")


#: Conversations have words; documents are calls of which only a transcript is left.
BARE = 1_000_000_000


@q("w04_turns_of_bare_transcripts", rf"""
SELECT call_id, turn_id::BIGINT AS turn_id, speaker, start_ms, end_ms, words, text, confidence, confidence < 0.6 AS uncertain FROM turns_v
UNION ALL SELECT doc_id + {BARE}, 1, '0', NULL, NULL, 0, t, 0.5, false FROM (SELECT doc_id, regexp_replace(text, '^{C._EDGE}|{C._EDGE}$', '', 'g') AS t FROM documents) x WHERE t <> ''
""", ("turns_v",))
def turns_of_bare_transcripts(spark, d):
    words = words_view(spark, d)
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("call_id"), F.col("text").alias("transcript"))
    bare = table(spark, d, "documents").select((F.col("doc_id") + BARE).alias("call_id"), F.col("text").alias("transcript"))
    return C.with_bare_transcripts(C.turns(words), words, said.unionByName(bare)).drop("chunk")


BG = """SELECT *, sum(CASE WHEN pe IS NULL OR NOT (start_ms - pe < 600) THEN 1 ELSE 0 END) OVER (PARTITION BY call_id ORDER BY turn, pos)::BIGINT AS run_id FROM
 (SELECT *, lag(end_ms) OVER (PARTITION BY call_id ORDER BY turn, pos) AS pe FROM words_v WHERE confidence < 0.7) a"""


@q("w04_background_runs", f"SELECT call_id, run_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY turn, pos) AS text, count(*) AS words FROM ({BG}) b GROUP BY 1, 2", ("words_v",))
def background_runs(spark, d):
    return C.background_runs(words_view(spark, d).where("confidence < 0.7"))


@q("w05_boundaries", """
SELECT call_id, turn_id::BIGINT AS turn_id, kind, floor(start_ms / 1000.0 * 100 + 0.5) / 100 AS at, ps AS from_speaker, speaker AS to_speaker, floor(gap * 100 + 0.5) / 100 AS gap_s, floor(overlap * 100 + 0.5) / 100 AS overlap_s,
 CASE kind WHEN 'simultaneous' THEN 0.9 WHEN 'backchannel' THEN 0.75 WHEN 'interruption' THEN CASE WHEN dangling THEN 0.7 ELSE 0.55 END ELSE 0.7 END * 1.0 AS sure, pc < 0.6 OR confidence < 0.6 AS unsure,
 CASE kind WHEN 'simultaneous' THEN 1 WHEN 'backchannel' THEN 1 WHEN 'interruption' THEN 2 + CAST(dangling AS INT) ELSE 1 END + CAST(pc < 0.6 OR confidence < 0.6 AS INT) AS n_evidence FROM boundaries_v
""", ("boundaries_v",))
def boundaries(spark, d):
    b = C.boundaries(C.turns(acted_words_view(spark, d)))
    unsure = F.col("confidence") == 0.4
    sure = F.when(F.col("kind") == "simultaneous", 0.9).when(F.col("kind") == "backchannel", 0.75).when(
        F.col("kind") == "interruption", F.when(F.exists("evidence", lambda e: e.startswith("the last word")), 0.7).otherwise(0.55)).otherwise(0.7)
    return b.select("call_id", "turn_id", "kind", "at", "from_speaker", "to_speaker", "gap_s", "overlap_s", sure.alias("sure"), unsure.alias("unsure"), F.size("evidence").alias("n_evidence"))


@q("w06_overlap_visibility", """
SELECT s.call_id, CASE WHEN n <= 1 THEN 'not_applicable' WHEN b.call_id IS NOT NULL THEN 'timestamps' ELSE 'limited' END AS overlap_visibility
FROM (SELECT call_id, count(DISTINCT speaker) AS n FROM acted_v GROUP BY 1) s LEFT JOIN (SELECT DISTINCT call_id FROM boundaries_v WHERE kind = 'simultaneous') b USING (call_id)
""", ("acted_v", "boundaries_v"))
def overlap_visibility(spark, d):
    w = acted_words_view(spark, d)
    return C.overlap_visibility(C.boundaries(C.turns(w)), C.speaker_counts(w))


@q("j16_turn_boundaries", """
SELECT t.call_id, t.turn_id::BIGINT AS turn_id, b.kind FROM acted_turns_v t LEFT JOIN (SELECT call_id, floor(start_ms / 10.0 + 0.5) AS at, kind FROM boundaries_v WHERE kind <> 'transition') b
 ON b.call_id = t.call_id AND b.at = floor(t.start_ms / 10.0 + 0.5)
""", ("boundaries_v",))
def turn_boundaries(spark, d):
    t = settle(C.turns(acted_words_view(spark, d)))
    return C.attach_boundaries(t, C.boundaries(t)).select("call_id", "turn_id", "kind")


METRICS = """
WITH base AS (SELECT call_id, count(*) AS n, count(*) FILTER (WHERE confidence < 0.7) AS low, count(*) FILTER (WHERE regexp_replace(lower(word), '[^a-z'']', '', 'g') IN ('uh','um','uhm','uhh','umm','er','erm','ah','hmm','mm','mmm')) AS fillers,
  avg(confidence) AS conf, (arg_max(end_ms, (turn, pos)) - arg_min(start_ms, (turn, pos))) / 1000.0 AS span FROM acted_v GROUP BY 1),
g AS (SELECT call_id, count(*) FILTER (WHERE gap > 700) AS p, count(*) FILTER (WHERE gap > 1500) AS lp, floor(greatest(0, COALESCE(max(gap), 0)) / 1000.0 * 10 + 0.5) / 10 AS longest FROM
  (SELECT call_id, start_ms - lag(end_ms) OVER (PARTITION BY call_id ORDER BY turn, pos) AS gap FROM acted_v) x GROUP BY 1),
t AS (SELECT call_id, count(*) AS turns FROM acted_turns_v GROUP BY 1),
e AS (SELECT call_id, count(*) FILTER (WHERE kind = 'simultaneous') AS sim, floor(COALESCE(sum(floor(overlap * 100 + 0.5) / 100) FILTER (WHERE kind = 'simultaneous'), 0) * 10 + 0.5) / 10 AS sim_s, count(*) FILTER (WHERE kind = 'interruption') AS cut, count(*) FILTER (WHERE kind = 'backchannel') AS ack FROM boundaries_v GROUP BY 1),
l AS (SELECT call_id, string_agg(regexp_replace(word, '[.,?!]', '', 'g'), '|' ORDER BY k) AS ws FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY turn, pos) AS k FROM acted_v WHERE confidence < 0.7) x WHERE k <= 12 GROUP BY 1)
SELECT base.call_id, n AS word_count, CASE WHEN span > 2 THEN CAST(floor(n / span * 60 + 0.5) AS BIGINT) END AS words_per_minute, round(conf, 9) AS avg_confidence, COALESCE(ws, '') AS low_confidence_words, round(low / n, 9) AS low_confidence_ratio, fillers AS filler_count,
 p AS pause_count, lp AS long_pause_count, longest AS longest_pause_s, turns AS turn_count, COALESCE(sim, 0) AS overlap_count, COALESCE(sim_s, 0) AS overlap_s, COALESCE(cut, 0) AS interruption_count, COALESCE(ack, 0) AS backchannel_count,
 speakers, duration_s
FROM base JOIN (SELECT call_id, CAST(count(DISTINCT speaker) AS INT) AS speakers, (max(end_ms) + 500) / 1000.0 AS duration_s FROM acted_v GROUP BY 1) d USING (call_id) LEFT JOIN g USING (call_id) LEFT JOIN t USING (call_id) LEFT JOIN e USING (call_id) LEFT JOIN l USING (call_id)
"""


@q("a24_k05_speech_metrics", METRICS, ("acted_v", "boundaries_v"))
def speech_metrics(spark, d):
    w = acted_words_view(spark, d)
    t = settle(C.turns(w))  # read by the turn counts and, twice, by the boundaries
    length = w.groupBy("call_id").agg(((F.max("end_ms") + 500) / 1000).alias("duration_s"))
    m = C.speech_metrics(w, t, C.boundaries(t), C.speaker_counts(w).join(length, "call_id"))
    return rounded(m.withColumn("low_confidence_words", F.array_join("low_confidence_words", "|")))


@q("a32_speaker_counts", "SELECT call_id, count(DISTINCT speaker) AS speakers FROM words_v GROUP BY 1", ("words_v",))
def speaker_counts(spark, d):
    return C.speaker_counts(words_view(spark, d))


@q("w16_timeline_layout", """
WITH l AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN -9000 ELSE 350 END AS gap, 40 * length(text) AS dur FROM conversations),
s AS (SELECT *, sum(gap + dur) OVER w - dur AS s0 FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
m AS (SELECT *, greatest(0, -min(s0) OVER (PARTITION BY conv_id ORDER BY turn)) AS lift FROM s)
SELECT conv_id, turn, (s0 + lift)::BIGINT AS start_at, (s0 + dur + lift)::BIGINT AS end_at FROM m
""")
def timeline_layout(spark, d):
    lines = table(spark, d, "conversations").selectExpr("conv_id", "turn", "CAST(CASE turn % 3 WHEN 0 THEN -9000 ELSE 350 END AS BIGINT) AS gap", "CAST(40 * length(text) AS BIGINT) AS dur")
    return C.timeline_layout(lines, key=["conv_id"], order="turn", gap="gap", duration="dur").select("conv_id", "turn", "start_at", "end_at")


@q("t15_prompt_table", """
SELECT call_id, string_agg('Speaker ' || CASE speaker WHEN 'user' THEN 1 ELSE 2 END || CASE WHEN confidence < 0.73 THEN ' (speaker uncertain)' ELSE '' END || ': ' || text, chr(10) ORDER BY turn_id) AS labelled FROM turns_v GROUP BY 1
""", ("turns_v",))
def prompt_table(spark, d):
    w = words_view(spark, d).withColumn("speaker", F.when(F.col("speaker") == "user", 0).otherwise(1))
    t = C.turns(w).withColumn("uncertain", F.col("confidence") < 0.73)
    return C.prompt_table(t, C.speaker_counts(w).withColumn("speakers", F.lit(2)))


@q("t25_turn_role", """
SELECT call_id, turn_id::BIGINT AS turn_id, CASE WHEN call_id % 5 = 0 THEN 'Caller' WHEN call_id % 5 = 1 THEN 'Voice ' || CASE speaker WHEN 'user' THEN 1 ELSE 2 END WHEN speaker = 'user' THEN 'Customer' ELSE 'Other voice' END AS role FROM turns_v
""", ("turns_v",))
def turn_role(spark, d):
    w = words_view(spark, d).withColumn("speaker", F.when(F.col("speaker") == "user", 0).otherwise(1))
    customer = P.customer_voice(F.when(F.col("call_id") % 5 != 1, F.lit(0)), F.when(F.col("call_id") % 5 == 0, 1).otherwise(2))
    return C.turns(w).select("call_id", "turn_id", P.turn_role("speaker", customer, F.when(F.col("call_id") % 5 == 0, 1).otherwise(2)).alias("role"))


SCRIPTED = """SELECT w.call_id, w.turn, w.pos, min(t.who) AS who FROM words_v w JOIN truth_v t ON t.call_id = w.call_id AND w.start_ms + w.end_ms BETWEEN 2 * t.start_ms - 100 AND 2 * t.end_ms + 100 GROUP BY 1, 2, 3 HAVING count(DISTINCT t.who) = 1"""


@q("j08_scripted_speaker", SCRIPTED, ("words_v", "truth_v"))
def scripted_speaker(spark, d):
    return I.scripted_speaker(words_view(spark, d), truth_view(spark, d))


@q("j09_outside_script", """
SELECT call_id, turn, pos FROM words_v w WHERE NOT EXISTS (SELECT 1 FROM truth_v t WHERE t.call_id = w.call_id AND w.start_ms + w.end_ms BETWEEN 2 * t.start_ms - 600 AND 2 * t.end_ms + 600)
""", ("words_v", "truth_v"))
def outside_script(spark, d):
    return I.outside_script(words_view(spark, d), truth_view(spark, d)).select("call_id", "turn", "pos")


@q("e07_background_scores", """
SELECT call_id, count(*) FILTER (WHERE NOT inside AND flagged) AS tp, count(*) FILTER (WHERE NOT inside AND NOT flagged) AS fn, count(*) FILTER (WHERE inside AND flagged) AS fp FROM
 (SELECT call_id, turn % 4 = 3 AND pos % 10 <> 0 OR pos = 1 AS flagged, EXISTS (SELECT 1 FROM truth_v t WHERE t.call_id = w.call_id AND w.start_ms + w.end_ms BETWEEN 2 * t.start_ms - 600 AND 2 * t.end_ms + 600) AS inside FROM words_v w) x GROUP BY 1
""", ("words_v", "truth_v"))
def background_scores(spark, d):
    from callgrain.operators import evaluation as E

    w = words_view(spark, d).withColumn("background", ((F.col("turn") % 4 == 3) & (F.col("pos") % 10 != 0)) | (F.col("pos") == 1))
    return E.background_scores(w, truth_view(spark, d))


@q("e04_a31_speaker_accuracy", f"""
WITH p AS (SELECT s.call_id, who, CASE WHEN w.pos % 9 = 0 THEN 1 WHEN speaker = 'user' THEN 0 ELSE 1 END AS label FROM ({SCRIPTED}) s JOIN words_v w USING (call_id, turn, pos)),
c AS (SELECT call_id, who, label, count(*) AS n FROM p GROUP BY 1, 2, 3), k AS (SELECT call_id, count(DISTINCT who) AS roles, count(DISTINCT label) AS labels, count(*) AS total FROM p GROUP BY 1),
a AS (SELECT r.call_id, max((2 * COALESCE(c.n, 0) + k.total - r.rn - l.ln) / k.total) AS best FROM (SELECT call_id, who, count(*) AS rn FROM p GROUP BY 1, 2) r JOIN (SELECT call_id, label, count(*) AS ln FROM p GROUP BY 1, 2) l ON l.call_id = r.call_id
  JOIN k ON k.call_id = r.call_id LEFT JOIN c ON c.call_id = r.call_id AND c.who = r.who AND c.label = l.label GROUP BY 1)
SELECT k.call_id, total AS pairs, round(CASE WHEN roles = 1 AND labels = 1 THEN 1.0 ELSE best END, 9) AS accuracy FROM k JOIN a USING (call_id)
""", ("words_v", "truth_v"))
def speaker_accuracy(spark, d):
    w = words_view(spark, d)
    label = F.when(F.col("pos") % 9 == 0, 1).when(F.col("speaker") == "user", 0).otherwise(1)
    pairs = I.scripted_speaker(w, truth_view(spark, d)).join(w.select(*I.WORD, label.alias("label")), I.WORD)
    return rounded(C.mapping_accuracy(pairs))


NEAREST = "{v}[CAST(least(len({v}) - 1, floor(len({v}) * {p})) AS BIGINT) + 1]"


@q("j07_span_features", f"""
WITH ph AS (SELECT call_id, phrase_id, min(start_ms) AS start_ms, arg_max(end_ms, (turn, pos)) AS end_ms FROM ({PHRASES}) p GROUP BY 1, 2),
m AS (SELECT ph.call_id, ph.phrase_id, count(*) AS frames, list(f0 ORDER BY f0) AS f, list(db ORDER BY db) AS l FROM ph JOIN frames_v f ON f.call_id = ph.call_id AND f.frame_idx >= floor(ph.start_ms / 50.0) AND f.frame_idx < ceil(ph.end_ms / 50.0) GROUP BY 1, 2)
SELECT ph.call_id, ph.phrase_id, COALESCE(frames, 0) AS frames, {NEAREST.format(v="f", p=0.5)} AS f0_median, {NEAREST.format(v="f", p=0.1)} AS f0_p10, {NEAREST.format(v="f", p=0.9)} AS f0_p90, {NEAREST.format(v="l", p=0.5)} AS level_db FROM ph LEFT JOIN m USING (call_id, phrase_id)
""", ("words_v", "frames_v"))
def span_features(spark, d):
    spans = C.phrase_spans(C.phrases(words_view(spark, d))).select("call_id", "phrase_id", "start_ms", "end_ms")
    out = I.span_features(frames_view(spark, d), spans, span_key=["call_id", "phrase_id"], hop_ms=50)
    return out.drop("start_ms", "end_ms")


_CEP = ", ".join(f"avg((f.frame_idx * {i + 3} % 17) / 8.0)" for i in range(12))


@q("j07_span_cepstra", f"""
WITH ph AS (SELECT call_id, phrase_id, min(start_ms) AS start_ms, arg_max(end_ms, (turn, pos)) AS end_ms FROM ({PHRASES}) p GROUP BY 1, 2)
SELECT ph.call_id, ph.phrase_id, array_to_string(list_transform([{_CEP}], lambda x: CAST(floor(x * 1000000 + 0.5) AS BIGINT)), ',') AS cep FROM ph JOIN frames_v f ON f.call_id = ph.call_id AND f.frame_idx >= floor(ph.start_ms / 50.0) AND f.frame_idx < ceil(ph.end_ms / 50.0) GROUP BY 1, 2
""", ("words_v", "frames_v"))
def span_cepstra(spark, d):
    """Mean cepstrum of the voiced frames of each phrase, in millionths."""
    spans = C.phrase_spans(C.phrases(words_view(spark, d))).select("call_id", "phrase_id", "start_ms", "end_ms")
    frames = frames_view(spark, d).withColumn("cep", F.transform(F.sequence(F.lit(3), F.lit(14)), lambda k: (F.col("frame_idx") * k % 17) / 8.0))
    out = I.span_features(frames, spans, span_key=["call_id", "phrase_id"], hop_ms=50, with_cep=True).where("frames > 0")
    return out.select("call_id", "phrase_id", F.array_join(F.transform("cep", lambda x: F.floor(x * 1000000 + 0.5).cast("string")), ",").alias("cep"))
