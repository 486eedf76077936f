"""From timed words to phrases, turns, turn boundaries and speech metrics.

Input words: (call_id, chunk, turn, pos, word, speaker, start_ms, end_ms, confidence).
``chunk`` is the unit ordered operators partition by; times are whole milliseconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import col, half_up
from callgrain.operators.sequence import islands, neighbours, running_sum

ORDER = ["turn", "pos"]
CALL = ["call_id"]

# fixed values: patterns for sentence ends and bare words
SENTENCE_END = r"[.?!][\"')]*$"


def ends_sentence(word: str | Column) -> Column:
    return F.rtrim(col(word)).rlike(SENTENCE_END)


def bare(word: str | Column, keep: str = "a-z'-") -> Column:
    return F.regexp_replace(F.lower(col(word)), f"[^{keep}]", "")


def seconds(ms: str | Column) -> Column:
    return col(ms) / 1000.0


def is_timed() -> Column:
    return F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()


def word_gaps(words: DataFrame) -> DataFrame:
    """Silence between each timed word and the timed word before it (null for the first), and its pause flags."""
    near = neighbours(words, key=CALL, chunk="chunk", order=ORDER, previous={"prev_end_ms": "end_ms"}, among=is_timed())
    gap = F.when(is_timed(), F.col("start_ms") - F.col("prev_end_ms"))
    return near.drop("is_first").withColumns({
        "gap_ms": gap, "is_pause": F.coalesce(gap > V.PAUSE_S * 1000, F.lit(False)), "is_long_pause": F.coalesce(gap > V.LONG_PAUSE_S * 1000, F.lit(False)),
    })


def phrases(words: DataFrame) -> DataFrame:
    """Words numbered by phrase: a new one starts after a pause, a sentence end, or missing timing."""
    def starts(cur, prev):
        gap = F.coalesce(cur("start_ms") - prev("end_ms"), F.lit(9000))
        return (gap > V.PHRASE_PAUSE_S * 1000) | ends_sentence(prev("word"))

    return islands(words, key=CALL, chunk="chunk", order=ORDER, uses=["start_ms", "end_ms", "word"], starts=starts, name="phrase_id")


def phrase_spans(numbered: DataFrame) -> DataFrame:
    """One row per phrase with its time span; phrases without a start or an end time are left out."""
    at = F.struct(*ORDER)
    return numbered.groupBy("call_id", "phrase_id").agg(
        F.min_by("start_ms", at).alias("start_ms"), F.max_by("end_ms", at).alias("end_ms"), F.count("*").alias("words"),
        F.min("chunk").alias("chunk"), F.min_by(at, at).alias("first_word"), F.max_by(at, at).alias("last_word"),
    ).where("start_ms IS NOT NULL AND end_ms IS NOT NULL")


def turns(words: DataFrame, attribution_confidence: str = "confidence") -> DataFrame:
    """Consecutive words of one speaker, merged. An unknown speaker equals an unknown speaker."""
    numbered = islands(
        words, key=CALL, chunk="chunk", order=ORDER, uses=["speaker"],
        starts=lambda cur, prev: ~cur("speaker").eqNullSafe(prev("speaker")), name="turn_id",
    )
    at = F.struct(*ORDER)
    first_end = F.max_by("end_ms", F.when(F.col("end_ms").isNotNull(), at))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "word"))), lambda w: w["word"]), " ")
    merged = numbered.groupBy("call_id", "turn_id").agg(
        F.min("chunk").alias("chunk"), F.min_by("speaker", at).alias("speaker"),
        F.min_by("start_ms", at).alias("start_ms"), first_end.alias("end_ms"), F.count("*").alias("words"),
        text.alias("text"), half_up(F.avg(attribution_confidence), 2).alias("confidence"),
    )
    return merged.withColumn("uncertain", F.col("speaker").isNull() | (F.col("confidence") < V.TURN_UNCERTAIN_BELOW))


#: What counts as white space at the ends of a transcript.
_EDGE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def with_bare_transcripts(turn_rows: DataFrame, words: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The turns, and one of speaker 0 without times for each call that has a transcript (call_id, transcript) but no words. Blank transcripts give none."""
    trimmed = F.regexp_replace("transcript", f"^{_EDGE}|{_EDGE}$", "")
    bare_calls = transcripts.select("call_id", trimmed.alias("text")).where("text <> ''").join(words.select("call_id").distinct(), "call_id", "left_anti")
    made = {"turn_id": F.lit(1), "speaker": F.lit("0"), "words": F.lit(0), "text": F.col("text"), "confidence": F.lit(0.5), "uncertain": F.lit(False), "chunk": F.lit(0)}
    kinds = {f.name: f.dataType for f in turn_rows.schema}
    one = bare_calls.select("call_id", *[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in turn_rows.columns if c != "call_id"])
    return turn_rows.unionByName(one)


def background_runs(words: DataFrame) -> DataFrame:
    """Background words (taken out of the conversation) merged while the gap stays under 0.6 s."""
    numbered = islands(
        words, key=CALL, chunk="chunk", order=ORDER, uses=["start_ms", "end_ms"],
        starts=lambda cur, prev: ~F.coalesce(cur("start_ms") - prev("end_ms") < V.BACKGROUND_MERGE_S * 1000, F.lit(False)), name="run_id",
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "word"))), lambda w: w["word"]), " ")
    return numbered.groupBy("call_id", "run_id").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), text.alias("text"), F.count("*").alias("words")
    )


def boundaries(turn_rows: DataFrame) -> DataFrame:
    """Every speaker change classified from the turn before, the turn itself and the turn after."""
    carried = {"prev_" + c: c for c in ("speaker", "start_ms", "end_ms", "text", "words", "uncertain")}
    near = neighbours(turn_rows, key=CALL, chunk="chunk", order=["turn_id"], previous=carried, following={"next_speaker": "speaker", "next_turn": "turn_id"})
    timed_pair = F.col("prev_start_ms").isNotNull() & F.col("prev_end_ms").isNotNull() & F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    pairs = near.where(~F.col("is_first") & timed_pair & ~F.col("speaker").eqNullSafe(F.col("prev_speaker")))
    gap = seconds(F.col("start_ms") - F.col("prev_end_ms"))
    overlap = F.greatest(F.lit(0.0), -gap)
    last_word = F.element_at(F.split(F.rtrim(F.col("prev_text")), r"\s+"), -1)
    tokens = F.split(F.trim("text"), r"\s+")
    short_ack = (F.size(tokens) <= 3) & F.forall(tokens, lambda w: bare(w).isin(*V.ACKNOWLEDGEMENTS))
    resumed = ~F.col("is_last") & F.col("next_speaker").eqNullSafe(F.col("prev_speaker"))
    finished = ends_sentence(last_word)
    cut = (F.col("prev_words") >= 3) & ~finished
    dangling = bare(last_word).isin(*V.DANGLING_WORDS)
    simultaneous, backchannel, interruption = overlap >= V.OVERLAP_MIN_S, short_ack & resumed & (F.col("prev_words") >= 3), cut & (gap < V.CUT_GAP_S)
    kind = F.when(simultaneous, "simultaneous").when(backchannel, "backchannel").when(interruption, "interruption").otherwise("transition")
    sure = F.when(simultaneous, 0.9).when(backchannel, 0.75).when(interruption, F.when(dangling, 0.7).otherwise(0.55)).otherwise(0.7)
    unsure = F.col("prev_uncertain") | F.col("uncertain")
    s = lambda x: half_up(x, 2).cast("string")
    # fixed values: wording of the evidence
    evidence = F.array_compact(F.array(
        F.when(simultaneous, F.concat(F.lit("word timestamps of the two speakers overlap by "), s(overlap), F.lit(" s"))),
        F.when(~simultaneous & backchannel, F.concat(F.size(tokens).cast("string"), F.lit('-word acknowledgement ("'), F.trim("text"), F.lit('") and the previous speaker carried on'))),
        F.when(~simultaneous & ~backchannel & interruption, F.concat(F.lit("the previous speaker's sentence stops without an ending (\"..."), last_word, F.lit('")'))),
        F.when(~simultaneous & ~backchannel & interruption, F.concat(F.lit("the other speaker starts "), F.when(gap <= 0.05, F.lit("immediately")).otherwise(F.concat(s(gap), F.lit(" s later"))))),
        F.when(~simultaneous & ~backchannel & interruption & dangling, F.lit("the last word is one a sentence does not normally end on")),
        F.when(~simultaneous & ~backchannel & ~interruption, F.concat(
            F.lit("the previous turn ended "), F.when(finished, F.lit("with a complete sentence")).otherwise(F.lit("without punctuation")),
            F.lit(", then a "), F.when(gap > 0.05, F.concat(s(gap), F.lit(" s pause"))).otherwise(F.lit("direct hand-over")))),
        F.when(unsure, F.lit("speaker attribution around this point is uncertain")),
    ))
    return pairs.select(
        "call_id", "turn_id", kind.alias("kind"), half_up(seconds("start_ms"), 2).alias("at"),
        F.col("prev_speaker").alias("from_speaker"), F.col("speaker").alias("to_speaker"),
        half_up(gap, 2).alias("gap_s"), half_up(overlap, 2).alias("overlap_s"),
        half_up(F.when(unsure, F.least(sure, F.lit(0.4))).otherwise(sure), 2).alias("confidence"), evidence.alias("evidence"),
    )


def overlap_visibility(boundary_rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Whether overlap can be seen at all in a call. ``speakers``: (call_id, speakers)."""
    seen = boundary_rows.groupBy("call_id").agg(F.bool_or(F.col("kind") == "simultaneous").alias("seen"))
    label = (
        F.when(F.coalesce("speakers", F.lit(1)) <= 1, "not_applicable").when(F.coalesce("seen", F.lit(False)), "timestamps").otherwise("limited")
    )
    return speakers.join(seen, "call_id", "left").select("call_id", label.alias("overlap_visibility"))


def attach_boundaries(turn_rows: DataFrame, boundary_rows: DataFrame) -> DataFrame:
    """Turns with the non-transition boundary that starts at their (rounded) start time."""
    marks = boundary_rows.where("kind <> 'transition'").select("call_id", F.col("at"), "kind")
    return turn_rows.withColumn("at", half_up(seconds("start_ms"), 2)).join(marks, ["call_id", "at"], "left")


def first_n(rows: DataFrame, key: str, order: list[str], value: Column, n: int, name: str) -> DataFrame:
    """The first n values of every key in order, as an array: ranked before anything is collected."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    top = rows.select(key, *order, value.alias("__v")).withColumn("__rank", rank).where(F.col("__rank") <= n)
    items = F.array_sort(F.collect_list(F.struct("__rank", "__v")))
    return top.groupBy(key).agg(F.transform(items, lambda x: x["__v"]).alias(name))


def speech_metrics(words: DataFrame, turn_rows: DataFrame, boundary_rows: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Per call: words, rate, confidence, fillers, pauses, speakers, turns and overlaps.

    ``word_confidence`` (boolean column of words) tells whether the recogniser
    gives a real confidence per word; without it those metrics stay empty.
    ``calls``: (call_id, speakers, duration_s) from the attribution and the recording; a call without them has one speaker
    if it has turns, and no duration.
    """
    if calls is None:
        calls = words.select("call_id", F.lit(None).cast("int").alias("speakers"), F.lit(None).cast("double").alias("duration_s")).distinct()
    rows = words if "word_confidence" in words.columns else words.withColumn("word_confidence", F.lit(True))
    low = F.col("word_confidence") & (F.col("confidence") < V.LOW_WORD_CONFIDENCE)
    filler = bare("word", "a-z'").isin(*V.FILLERS)
    at = F.when(is_timed(), F.struct(*ORDER))
    base = word_gaps(rows).groupBy("call_id").agg(
        F.count("*").alias("word_count"), F.count_if(low).alias("low_n"), F.count_if(filler).alias("filler_count"),
        F.avg(F.when(F.col("word_confidence"), F.col("confidence"))).alias("avg_confidence"),
        F.min_by("start_ms", at).alias("t0"), F.max_by("end_ms", at).alias("t1"),
        F.count_if("is_pause").alias("pause_count"), F.count_if("is_long_pause").alias("long_pause_count"),
        half_up(F.greatest(F.lit(0.0), F.coalesce(F.max("gap_ms"), F.lit(0)) / 1000.0), 1).alias("longest_pause_s"),
    )
    spoken = turn_rows.groupBy("call_id").agg(F.count("*").alias("turn_count"))
    events = boundary_rows.groupBy("call_id").agg(
        F.count_if(F.col("kind") == "simultaneous").alias("overlap_count"),
        half_up(F.sum(F.when(F.col("kind") == "simultaneous", F.col("overlap_s")).otherwise(0.0)), 1).alias("overlap_s"),
        F.count_if(F.col("kind") == "interruption").alias("interruption_count"), F.count_if(F.col("kind") == "backchannel").alias("backchannel_count"),
    )
    unclear = first_n(rows.where(low), "call_id", ORDER, F.regexp_replace("word", "[.,?!]", ""), 12, "low_confidence_words")
    span = (F.col("t1") - F.col("t0")) / 1000.0
    zero = F.lit(0).cast("bigint")
    return (
        base.join(spoken, "call_id", "left").join(events, "call_id", "left").join(unclear, "call_id", "left").join(calls, "call_id", "left")
        .select(
            "call_id", "duration_s", "word_count", F.when(span > 2, half_up(F.col("word_count") / span * 60)).cast("bigint").alias("words_per_minute"),
            "avg_confidence", F.coalesce("low_confidence_words", F.array().cast("array<string>")).alias("low_confidence_words"),
            (F.col("low_n") / F.col("word_count")).alias("low_confidence_ratio"), "filler_count",
            "pause_count", "long_pause_count", "longest_pause_s",
            F.coalesce(F.col("speakers").cast("int"), F.when(F.col("turn_count") > 0, 1).otherwise(0)).alias("speakers"), F.coalesce("turn_count", zero).alias("turn_count"),
            F.coalesce("overlap_count", zero).alias("overlap_count"), F.coalesce("overlap_s", F.lit(0.0)).alias("overlap_s"),
            F.coalesce("interruption_count", zero).alias("interruption_count"), F.coalesce("backchannel_count", zero).alias("backchannel_count"),
        )
    )


def speaker_counts(words: DataFrame) -> DataFrame:
    """Distinct known speakers per call."""
    per_speaker = words.where("speaker IS NOT NULL").groupBy("call_id", "speaker").agg(F.lit(1).alias("one"))
    return per_speaker.groupBy("call_id").agg(F.count("*").alias("speakers"))


def mapping_accuracy(pairs: DataFrame) -> DataFrame:
    """Best agreement of labels with roles per call, over all (label, role) pairings.

    ``pairs``: (call_id, who, label). Works on the co-occurrence counts.
    """
    cells = pairs.where("who IS NOT NULL AND label IS NOT NULL").groupBy("call_id", "who", "label").agg(F.count("*").alias("n"))
    call, role, lab = W.partitionBy("call_id"), W.partitionBy("call_id", "who"), W.partitionBy("call_id", "label")
    total = F.sum("n").over(call)
    # every pairing, also of a role and a label that never met: agreement = (both + neither) / all
    met = cells.select("*", total.alias("total"), F.sum("n").over(role).alias("role_n"), F.sum("n").over(lab).alias("label_n"))
    roles = met.groupBy("call_id", "who").agg(F.max("role_n").alias("role_n"), F.max("total").alias("total"))
    labels = met.groupBy("call_id", "label").agg(F.max("label_n").alias("label_n"))
    every = roles.join(labels, "call_id").join(cells, ["call_id", "who", "label"], "left")
    both = F.coalesce("n", F.lit(0))
    agree = (both + F.col("total") - F.col("role_n") - F.col("label_n") + both) / F.col("total")
    out = every.groupBy("call_id").agg(
        F.max("total").alias("pairs"), F.max(agree).alias("best"), F.count_distinct("who").alias("roles"), F.count_distinct("label").alias("labels")
    )
    return out.select("call_id", "pairs", F.when((F.col("roles") == 1) & (F.col("labels") == 1), 1.0).otherwise(F.col("best")).alias("accuracy"))


def timeline_layout(lines: DataFrame, *, key: list[str], order: str, gap: str, duration: str, chunk: str | None = None) -> DataFrame:
    """Start and end of every line: start = max(0, previous end + gap), a negative gap overlaps.

    end_i = dur_i + max(0, end_{i-1} + gap_i). Unrolled, the end is the running
    total of gap + duration lifted by the deepest dip of the running starts
    below zero so far, so two running windows replace the sequential loop.
    """
    if chunk is None:
        lines, chunk = lines.withColumn("__chunk", F.expr(f"{order} div 1024")), "__chunk"
    summed = running_sum(lines, key=key, chunk=chunk, order=[order], sums={"__run": F.col(gap) + F.col(duration)})
    start = F.col("__run") - F.col(duration)
    part = [*key, chunk]
    inner = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    lows = summed.groupBy(*part).agg(F.min(start).alias("__low"))
    before = W.partitionBy(*key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    lows = lows.select(*part, F.min("__low").over(before).alias("__low_before"))
    dipped = summed.select("*", F.min(start).over(inner).alias("__dip")).join(lows, part)
    lift = F.greatest(F.lit(0), -F.least(F.col("__dip"), F.coalesce("__low_before", F.col("__dip"))))
    keep = [c for c in lines.columns if c != "__chunk"]
    return dipped.select(*keep, (start + lift).alias("start_at"), (F.col("__run") + lift).alias("end_at"))


def prompt_table(turn_rows: DataFrame, speakers: DataFrame) -> DataFrame:
    """Labelled transcript per call, the input table of an offline inference job."""
    mark = F.when(F.col("uncertain") & (F.col("speakers") > 1), F.lit(" (speaker uncertain)")).otherwise(F.lit(""))
    line = F.concat(F.lit("Speaker "), (F.coalesce(F.col("speaker"), F.lit(0)) + 1).cast("string"), mark, F.lit(": "), F.col("text"))
    rows = turn_rows.join(speakers, "call_id", "left").select("call_id", "turn_id", line.alias("line"))
    return rows.groupBy("call_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "line"))), lambda x: x["line"]), "\n").alias("labelled")
    )


def script_text(lines: DataFrame, *, key: str, order: str, role: str, text: str) -> DataFrame:
    """Script of a call: plain text, and 'Role: text' lines when more than one role speaks."""
    who = F.coalesce(F.col(role), F.lit("customer"))
    shown = F.concat(F.when(who == "agent", F.lit("Agent")).otherwise(F.lit("Customer")), F.lit(": "), F.col(text))
    packed = lines.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), shown.alias("s")))).alias("x"),
        F.min(who).alias("__a"), F.max(who).alias("__b"),
    )
    plain = F.array_join(F.transform("x", lambda r: r["t"]), " ")
    return packed.select(
        key, plain.alias("script_plain"),
        F.when(F.col("__a") != F.col("__b"), F.array_join(F.transform("x", lambda r: r["s"]), "\n")).otherwise(plain).alias("script_display"),
    )
