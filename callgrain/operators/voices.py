"""How each voice sounds: rate, pauses, pitch movement, loudness, and what that may be said to mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import half_up, semitones, semitones_to_hz
from callgrain.operators import conversation as C
from callgrain.operators.intervals import voiced_under
from callgrain.operators.quantiles import nearest_rank_by
from callgrain.operators.sequence import neighbours

VOICE = ["call_id", "voice"]


def measure_voices(words: DataFrame, frames: DataFrame, hop_ms: float) -> DataFrame:
    """Measurements per (call, voice) with at least five timed words. ``words`` carries ``voice``."""
    spoken = words.where(C.is_timed() & F.col("voice").isNotNull())
    near = neighbours(spoken, key=VOICE, chunk="chunk", order=C.ORDER, previous={"__end": "end_ms"})
    gap = C.seconds(F.col("start_ms") - F.col("__end"))
    pause = F.when((gap > 0.3) & (gap < 8), gap)
    filler = C.bare("word", "a-z").isin(*V.FILLERS)
    at = F.struct(*C.ORDER)
    base = near.groupBy(*VOICE).agg(
        F.count("*").alias("words"), F.count_if(filler).alias("filler_count"), F.coalesce(F.sum(pause), F.lit(0.0)).alias("pause_s"),
        F.count_if(pause > 1).alias("long_pauses"), F.min_by("start_ms", at).alias("t0"), F.max_by("end_ms", at).alias("t1"),
    ).where("words >= 5")
    under = voiced_under(frames, spoken.select(*VOICE, "turn", "pos", "start_ms", "end_ms"), hop_ms=hop_ms, rounding="round").select(
        *VOICE, semitones("f0").alias("st"), "db"
    )
    ranks = nearest_rank_by(under, VOICE, "st", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, width=0.25)
    level = under.groupBy(*VOICE).agg(F.count("*").alias("frames"), F.when(F.count("*") >= 2, F.stddev_pop("db")).alias("sd"))
    rows = base.join(ranks, VOICE, "left").join(level, VOICE, "left")
    span = C.seconds(F.col("t1") - F.col("t0"))
    talk = F.greatest(F.lit(0.5), span - F.col("pause_s"))
    whole = F.greatest(span, F.lit(1.0))
    return rows.select(
        *VOICE, "words", (F.coalesce("frames", F.lit(0)) * (hop_ms / 1000.0)).alias("speech_s"),
        semitones_to_hz("p50").alias("pitch_hz"), half_up(F.col("p90") - F.col("p10"), 1).alias("pitch_range_st"), half_up("sd", 1).alias("loudness_sd_db"),
        F.when(span > 2, half_up((F.col("words") - F.col("filler_count")) / talk * 60)).alias("articulation_wpm"),
        half_up(F.col("pause_s") / whole, 2).alias("pause_ratio"), "long_pauses",
        half_up(F.col("filler_count") / whole * 60, 1).alias("fillers_per_min"), "filler_count",
    )


def cue_ids(loudness_trusted: Column) -> Column:
    """Delivery cues of one voice, in a fixed order."""
    wpm, st, sd = F.col("articulation_wpm"), F.col("pitch_range_st"), F.col("loudness_sd_db")
    hesitant = (F.col("fillers_per_min") >= V.HESITANT_FILLERS_PER_MIN) | ((F.col("pause_ratio") >= V.HESITANT_PAUSE_RATIO) & (F.col("long_pauses") >= V.LONG_PAUSE_COUNT))
    cue = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(F.array(
        cue(wpm >= V.FAST_WPM, "fast"), cue(wpm <= V.SLOW_WPM, "slow"),
        F.when(hesitant, F.lit("hesitant")).when(F.col("long_pauses") >= V.LONG_PAUSE_COUNT, F.lit("long_pauses")),
        cue(st >= V.WIDE_ST, "wide_pitch"), cue(st <= V.NARROW_ST, "narrow_pitch"),
        cue(loudness_trusted & (sd >= V.SWING_DB), "loudness_swings"), cue(loudness_trusted & (sd <= V.STEADY_DB), "steady_loudness"),
    ))


def cue_text(cue: Column) -> Column:
    s = lambda c: F.regexp_replace(F.col(c).cast("string"), r"\.0$", "")
    pct = half_up(F.col("pause_ratio") * 100).cast("bigint").cast("string")
    # fixed values: wording of the cues
    return (
        F.when(cue == "fast", F.concat(F.lit("fast speech ("), s("articulation_wpm"), F.lit(" words per minute)")))
        .when(cue == "slow", F.concat(F.lit("slow speech ("), s("articulation_wpm"), F.lit(" words per minute)")))
        .when(cue == "hesitant", F.concat(F.lit("hesitant delivery ("), s("fillers_per_min"), F.lit(" fillers/min, "), pct, F.lit("% of the time in pauses)")))
        .when(cue == "long_pauses", F.concat(s("long_pauses"), F.lit(" long pauses")))
        .when(cue == "wide_pitch", F.concat(F.lit("wide pitch movement ("), s("pitch_range_st"), F.lit(" semitones)")))
        .when(cue == "narrow_pitch", F.concat(F.lit("narrow pitch movement ("), s("pitch_range_st"), F.lit(" semitones)")))
        .when(cue == "loudness_swings", F.concat(F.lit("large loudness swings ("), s("loudness_sd_db"), F.lit(" dB)")))
        .when(cue == "steady_loudness", F.concat(F.lit("very steady loudness ("), s("loudness_sd_db"), F.lit(" dB)")))
    )


def judge_delivery(voices: DataFrame) -> DataFrame:
    """Activation level per voice from agreeing cues; never above medium confidence.

    ``voices`` carries the signal columns snr_db, band_limited, clipping_ratio
    and dynamics_compressed (all null when the recording was not measured).
    """
    measured = F.col("snr_db").isNotNull()
    trusted = measured & ~F.coalesce("dynamics_compressed", F.lit(False)) & (F.coalesce("snr_db", F.lit(-1.0)) >= V.MIN_LOUDNESS_SNR_DB)
    rows = voices.withColumn("cues", cue_ids(trusted))
    n = lambda names: F.size(F.filter("cues", lambda c: c.isin(*names)))
    rows = rows.withColumns({"up": n(["fast", "wide_pitch", "loudness_swings"]), "down": n(["slow", "narrow_pitch", "steady_loudness"])})
    score = F.col("up") - F.col("down")
    clean = F.coalesce((F.col("snr_db") >= V.MIN_TONE_SNR_DB) & ~F.col("band_limited") & (F.col("clipping_ratio") < V.CLIPPING_RATIO), F.lit(False))
    little, noisy = F.col("speech_s") < V.MIN_TONE_SPEECH_S, ~measured | (F.coalesce("snr_db", F.lit(-1.0)) < V.MIN_TONE_SNR_DB)
    arousal = (
        F.when(little | noisy, "unclear").when((score >= 2) & (F.col("down") == 0), "high").when((score <= -2) & (F.col("up") == 0), "low")
        .when((F.col("up") == 0) & (F.col("down") == 0), "medium").otherwise("unclear")
    )
    # fixed values: wording of the reasons
    count = lambda c: F.col(c).cast("string")
    reason = (
        F.when(little, F.concat(F.lit("Only "), half_up("speech_s").cast("bigint").cast("string"), F.lit(" s of clear speech from this speaker; too little to judge how it sounds.")))
        .when(noisy, F.lit("The recording is too noisy (or could not be measured) to judge how the voice sounds."))
        .when(F.col("arousal") == "high", F.concat(count("up"), F.lit(" cues agree on an animated delivery.")))
        .when(F.col("arousal") == "low", F.concat(count("down"), F.lit(" cues agree on a subdued delivery.")))
        .when(F.col("arousal") == "medium", F.lit("Rate, pitch movement and loudness are all in the ordinary range."))
        .otherwise(F.lit("The delivery cues point in different directions, so no activation level is claimed."))
    )
    weak = F.when((F.col("arousal") != "unclear") & ~clean, F.lit(" The recording is noisy or band-limited, which distorts pitch and loudness, so this is a weak indication.")).otherwise(F.lit(""))
    sure = (F.col("arousal") != "unclear") & clean & (F.abs(score) >= 2) & (F.col("speech_s") >= V.MEDIUM_CONFIDENCE_SPEECH_S)
    out = rows.withColumn("arousal", arousal)
    return out.withColumns({
        "voice_confidence": F.when(sure, "medium").otherwise("low"), "reason": F.concat(reason, weak),
        "cue_texts": F.transform("cues", cue_text),
    }).drop("up", "down")


def compose_tone(df: DataFrame) -> DataFrame:
    """Combines the emotion of the words with the sound of the voice; never averages the two.

    Reads emotion, intensity (null = no reading of the words) and arousal,
    cues, voice_confidence (null = no reading of the voice). Adds tone_label,
    tone_confidence, agreement.
    """
    emotion, arousal = F.col("emotion"), F.col("arousal")
    words = F.coalesce(emotion.isNotNull() & ~emotion.isin(*V.NO_EMOTION), F.lit(False))
    voice = F.coalesce(arousal.isNotNull() & (arousal != "unclear"), F.lit(False))
    hesitant = F.coalesce(F.array_contains("cues", "hesitant"), F.lit(False))
    high, calm = emotion.isin(*V.HIGH_ENERGY_EMOTIONS), emotion.isin(*V.CALM_EMOTIONS)
    agree = (high & ((arousal == "high") | ((emotion == "nervous") & hesitant))) | (calm & (arousal != "high")) | ((emotion == "confused") & (hesitant | (arousal == "low")))
    differ = (high & (arousal == "low")) | (calm & (arousal == "high"))
    agreement = (
        F.when(~words & ~voice, "insufficient").when(words & ~voice, "words_only").when(~words & voice, "voice_only")
        .when(agree, "agree").when(differ, "differ").otherwise("words_only")
    )
    sound = F.when(arousal == "high", "animated delivery").when(arousal == "low", "subdued delivery").when(hesitant, "hesitant delivery").otherwise("even delivery")
    mixed = F.concat(F.lit("mixed signals: wording suggests "), emotion, F.lit(", delivery sounds "), F.when(arousal == "low", "subdued").otherwise("animated"))
    rows = df.withColumn("agreement", agreement)
    label = (
        F.when(F.col("agreement") == "insufficient", F.lit("not evident")).when(F.col("agreement") == "voice_only", sound)
        .when(F.col("agreement") == "differ", mixed).otherwise(emotion)
    )
    sure = (F.col("agreement") == "agree") & (F.col("voice_confidence") == "medium") & (F.coalesce("intensity", F.lit("low")) != "low")
    return rows.withColumns({"tone_label": label, "tone_confidence": F.when(sure, "medium").otherwise("low")})


def customer_voice_rows(voices: DataFrame, calls: DataFrame) -> DataFrame:
    """Measurements of the customer's voice: the understood speaker, else the only voice of a one-voice call."""
    speaker = F.coalesce("customer_speaker", F.when(F.col("speakers") <= 1, F.lit(0)))
    lone = voices.groupBy("call_id").agg(F.count("*").alias("n_voices"), F.min("voice").alias("only_voice"))
    wanted = calls.withColumn("__want", speaker).join(lone, "call_id", "left")
    named = wanted.join(voices.select(F.col("call_id"), F.col("voice").alias("__want")), ["call_id", "__want"], "left_semi").select("call_id", F.col("__want").alias("voice"))
    fallback = wanted.join(named.select("call_id"), "call_id", "left_anti").where((F.col("n_voices") == 1) & (F.col("speakers") <= 1)).select("call_id", F.col("only_voice").alias("voice"))
    return voices.join(named.unionByName(fallback), VOICE)
