"""Plain-language findings from one wide row per call, and the difficulty they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import half_up, lookup

WIDE = """call_id BIGINT, snr_db DOUBLE, noise_floor_db DOUBLE, band_limited BOOLEAN, hf_ratio_db DOUBLE, sample_rate INT, dynamics_compressed BOOLEAN,
 level_sd_db DOUBLE, clipping_ratio DOUBLE, word_count BIGINT, words_per_minute BIGINT, avg_confidence DOUBLE, low_confidence_words ARRAY<STRING>,
 low_confidence_ratio DOUBLE, filler_count BIGINT, pause_count BIGINT, long_pause_count BIGINT, longest_pause_s DOUBLE, speakers INT, overlap_s DOUBLE,
 stt_provider STRING, source STRING, reliable BOOLEAN, voice_pitch_hz ARRAY<INT>, notes ARRAY<STRING>, uncertain_turns BIGINT,
 simultaneous_n BIGINT, cut_at ARRAY<DOUBLE>, cut_evidence STRING, overlap_visibility STRING, background_texts ARRAY<STRING>, off_topic ARRAY<STRING>,
 voice_fillers BIGINT, voice_long_pauses BIGINT, voice_wpm DOUBLE, understood BOOLEAN, corrections ARRAY<STRING>, ambiguities ARRAY<STRING>,
 intents ARRAY<STRING>, repetitions ARRAY<STRING>, late_information ARRAY<STRING>, intent_confidence STRING, dropped_unverified BIGINT"""


def with_missing_columns(df: DataFrame) -> DataFrame:
    """Adds the columns of the wide row that are not there, as null ('not measured')."""
    have = set(df.columns)
    extra = {f.name: F.lit(None).cast(f.dataType) for f in _wide_fields() if f.name not in have}
    return df.withColumns(extra) if extra else df


def _wide_fields():
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(WIDE).fields


def _n(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def _pct(c: Column) -> Column:
    return F.concat(half_up(c * 100).cast("bigint").cast("string"), F.lit("%"))


def _plural(n: Column, word: str) -> Column:
    return F.concat(_n(n), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def _quoted(values: Column, n: int, sep: str = '", "') -> Column:
    return F.array_join(F.slice(values, 1, n), sep)


def rules() -> list[Column]:
    """The threshold rules in reporting order. # fixed values: ids, thresholds and wording."""
    c = F.col
    no = F.lit(False)
    arr = lambda name: F.coalesce(c(name), F.array().cast("array<string>"))
    some = lambda name: F.size(arr(name)) > 0

    def finding(when: Column, id_: str, severity: str, area: str, title, detail: Column) -> Column:
        title = F.lit(title) if isinstance(title, str) else title
        return F.when(F.coalesce(when, no), F.struct(
            F.lit(id_).alias("id"), F.lit(severity).alias("severity"), F.lit(area).alias("area"), title.alias("title"), detail.alias("detail")))

    t = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    signal = c("snr_db").isNotNull()
    db = half_up("snr_db").cast("bigint").cast("string")
    deepgram = c("avg_confidence").isNotNull() & (c("stt_provider") == "deepgram")
    low_conf = deepgram & (c("avg_confidence") < 0.85)
    words = arr("low_confidence_words")
    own = c("voice_fillers").isNotNull()
    fillers, pauses = F.coalesce("voice_fillers", "filler_count"), F.coalesce("voice_long_pauses", "long_pause_count")
    wpm = F.when(own, c("voice_wpm")).otherwise(c("words_per_minute").cast("double"))
    whose = F.when(own, F.lit("the customer's voice")).otherwise(F.lit("the recording"))
    attributed = c("source").isNotNull()
    many = c("speakers") >= 2
    cuts = F.coalesce(F.size("cut_at"), F.lit(0))
    sims = F.coalesce("simultaneous_n", F.lit(0))
    talk_over = F.when(sims > 0, t("speakers talk over each other ", F.when(sims == 1, F.lit("once")).otherwise(F.concat(sims.cast("string"), F.lit(" times"))), " (", _n(c("overlap_s")), " s, confirmed by word timestamps)"))
    cut_off = F.when(cuts > 0, t(_plural(cuts, "sentence"), " cut off by the other speaker (at ", F.array_join(F.transform("cut_at", lambda x: F.concat(_n(x), F.lit(" s"))), ", "), "; ", F.coalesce("cut_evidence", F.lit("")), ")"))
    origin = F.when(c("source") == "acoustic", "Found from the audio itself (the recognizer reported one speaker)").when(
        c("source") == "recognizer+acoustic", "Confirmed by both the recognizer and the audio").otherwise("Reported by the recognizer")
    pitches = F.when(F.size("voice_pitch_hz") == 2, t("; typical pitch ", c("voice_pitch_hz")[0].cast("string"), " Hz and ", c("voice_pitch_hz")[1].cast("string"), " Hz")).otherwise(F.lit(""))
    quotes = F.array_join(F.transform(F.slice(F.concat(arr("background_texts"), arr("off_topic")), 1, 2), lambda q: t('"', q, '"')), ", ")
    understood = F.coalesce("understood", no)
    intents = arr("intents")
    named = F.transform(intents, lambda i: F.replace(i, F.lit("_"), F.lit(" ")))
    return [
        finding(signal & (c("snr_db") < 12), "noise_heavy", "issue", "audio", "Heavy background noise", t("Speech is only about ", db, " dB above the noise (noise floor ", _n(c("noise_floor_db")), " dB).")),
        finding(signal & (c("snr_db") >= 12) & (c("snr_db") < 26), "noise", "warn", "audio", "Background noise", t("Speech is about ", db, " dB above the noise floor, so the recognizer has less margin.")),
        finding(signal & c("band_limited"), "band_limited", "warn", "audio", "Limited bandwidth (phone-like, muffled or low-rate audio)", F.when(
            c("hf_ratio_db").isNull(), t("The recording sample rate is only ", c("sample_rate").cast("string"), " Hz, so high frequencies are missing.")).otherwise(
            t("Almost nothing above 5 kHz (", _n(c("hf_ratio_db")), " dB relative to the speech band), which hides consonants such as s, f and t."))),
        finding(signal & c("dynamics_compressed"), "compressed", "info", "audio", "Heavily compressed loudness", t("Loudness barely varies (", _n(c("level_sd_db")), " dB), typical of a phone line or automatic gain control; quiet words can be lost.")),
        finding(signal & (c("clipping_ratio") > V.CLIPPING_RATIO), "clipping", "warn", "audio", "Audio clipping", t(F.format_string("%.1f", c("clipping_ratio") * 100), "% of samples are at full scale.")),
        finding(~signal & (c("low_confidence_ratio") >= 0.1), "noise", "warn", "audio", "Degraded audio", t(_plural(half_up(c("low_confidence_ratio") * c("word_count")).cast("bigint"), "word"), " (", _pct(c("low_confidence_ratio")), ") were hard for the recognizer to hear.")),
        finding(low_conf, "stt_low", "issue", "speech", "Low transcription confidence", t("Average word confidence ", _pct(c("avg_confidence")), '; words like "', _quoted(words, 4), '" are likely misheard.')),
        finding(deepgram & ~low_conf & ((c("avg_confidence") < 0.95) | (F.size(words) >= 3)), "stt_reduced", "warn", "speech", "Reduced transcription confidence", t(
            "Average word confidence ", _pct(c("avg_confidence")), F.when(F.size(words) > 0, t('; uncertain words: "', _quoted(words, 5), '"')).otherwise(F.lit("")), ".")),
        finding(fillers >= 8, "hesitation_heavy", "warn", "speech", "Very hesitant speech", t(_plural(fillers, "filler word"), " (um, uh) in ", whose, ".")),
        finding((fillers >= 3) & (fillers < 8), "hesitation", "warn", "speech", "Hesitant speech", t(_plural(fillers, "filler word"), " (um, uh) in ", whose, ".")),
        finding(pauses >= 1, "long_pauses", "warn", "speech", "Long pauses", t(_plural(pauses, "pause"), " over ", F.when(own, F.lit("1")).otherwise(F.lit("1.5")), " s",
            F.when(own, F.lit("")).otherwise(t("; the longest was ", _n(c("longest_pause_s")), " s")), " in ", whose, ".")),
        finding((F.coalesce(pauses, F.lit(0)) < 1) & (c("pause_count") >= 4), "pauses", "info", "speech", "Frequent pauses", t(_plural(c("pause_count"), "pause"), " over 0.7 s.")),
        finding(wpm > 185, "fast", "warn", "speech", "Fast speech", t("About ", _n(wpm), " words per minute in ", whose, " (conversational is roughly 130-165).")),
        finding(wpm < 105, "slow", "info", "speech", "Slow speech", t("About ", _n(wpm), " words per minute in ", whose, ".")),
        finding(attributed & many, "speakers", "info", "conversation", t(c("speakers").cast("string"), " speakers detected"), t(origin, pitches, ".")),
        finding(attributed & ~c("reliable"), "attribution_uncertain", "warn", "conversation", "Who said what is uncertain", F.coalesce(
            F.get(arr("notes"), F.lit(0)), F.lit("Speaker labels could not be verified from the audio, so details are not attributed to a speaker."))),
        finding(attributed & c("reliable") & (c("uncertain_turns") > 0) & many, "attribution_partial", "info", "conversation", "Some lines could not be attributed", t(
            c("uncertain_turns").cast("string"), " short line(s) are marked uncertain because the voice evidence was weak.")),
        finding((sims > 0) | (cuts > 0), "overlap", "warn", "conversation", "Interruptions", t(F.array_join(F.array_compact(F.array(talk_over, cut_off)), "; "), ".")),
        finding(c("overlap_visibility") == "limited", "overlap_limited", "info", "conversation", "Overlapping speech may be hidden", F.lit(
            "This is a single-channel recording: when two people talk at once the recognizer usually keeps only the louder voice, so interruptions are a lower bound.")),
        finding(some("background_texts") | some("off_topic"), "background_speech", "warn", "audio", "Speech from the environment", t(F.when(
            some("background_texts"), F.lit("Quiet speech that is not the caller or agent was left out of the conversation")).otherwise(F.lit("Some words in the transcript do not belong to the call")), ": ", quotes, ".")),
        finding(understood & some("corrections"), "corrections", "warn", "content", t("Customer corrected ", _plural(F.size(arr("corrections")), "detail")), F.array_join(F.slice(arr("corrections"), 1, 3), "; ")),
        finding(understood & some("ambiguities"), "ambiguity", "warn", "content", "Unclear or conflicting information", F.get(arr("ambiguities"), F.lit(0))),
        finding(understood & (F.size(intents) >= 3), "multi_intent", "warn", "content", t(F.size(intents).cast("string"), " separate issues raised"), F.array_join(named, ", ")),
        finding(understood & (F.size(intents) == 2), "two_intents", "info", "content", "Two related issues raised", F.array_join(named, " and ")),
        finding(understood & some("repetitions"), "repetition", "info", "content", "Customer repeated information", F.get(arr("repetitions"), F.lit(0))),
        finding(understood & some("late_information"), "late", "info", "content", "Key detail came late", F.get(arr("late_information"), F.lit(0))),
        finding(understood & (c("intent_confidence") == "low"), "intent_unclear", "warn", "content", "Intent is unclear", F.lit("The request could not be pinned down with confidence.")),
        finding(understood & (c("dropped_unverified") > 0), "ungrounded", "info", "content", "Some extracted details were discarded", t(
            _plural(c("dropped_unverified"), "detail"), " proposed by the language model did not appear in the transcript and were removed.")),
    ]


def with_findings(wide: DataFrame) -> DataFrame:
    """Adds ``findings``, the array of findings of every call."""
    return with_missing_columns(wide).withColumn("findings", F.array_compact(F.array(*rules())))


def difficulty(findings: Column) -> Column:
    score = F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + F.coalesce(lookup(V.SEVERITY_WEIGHT, f["severity"]), F.lit(0.0)))
    label = F.when(score < 2, "Easy").when(score < 5, "Moderate").when(score < 9, "Hard").otherwise("Severe")
    return F.struct(score.alias("score"), label.alias("label"))


def notable(findings: Column, n: int = 3) -> Column:
    """Titles of the first findings that are more than a note."""
    return F.slice(F.transform(F.filter(findings, lambda f: f["severity"] != "info"), lambda f: f["title"]), 1, n)


def per_area(with_found: DataFrame) -> DataFrame:
    """Findings per area and id over all calls."""
    long = with_found.select("call_id", F.inline("findings"))
    return long.groupBy("area", "id", "severity").agg(F.count("*").alias("n"))
