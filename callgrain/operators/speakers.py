"""Who spoke each word: pitch groups of phrases, smoothed word labels, repairs and a summary.

A second voice is reported only when the phrases of a call fall into two
clearly separated pitch groups. All per-call statistics are selections over
counted bins or sums, and the ordered steps run per (call, chunk) with small
summaries chained per call, so a call of any length is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import half_up, semitones, semitones_to_hz
from callgrain.operators import conversation as C
from callgrain.operators.intervals import span_features
from callgrain.operators.quantiles import nearest_rank_by
from callgrain.operators.sequence import islands, neighbours, per_key_stream, running_sum
from callgrain.sources.settle import release, settle

WORD = ["call_id", "turn", "pos"]


# --------------------------------------------------------------- two groups


def two_groups(df: DataFrame, *, key: Sequence[str], value: str, weight: str, tie: str, bin_width: float = 1.0) -> DataFrame:
    """Best split of weighted values in two: every cut is tried, between-group variance decides.

    Returns per key: cut, gap, delta, dprime, lo_weight, hi_weight, accepted.
    Sums before a cut come from a running sum over value bins, so the sorted
    values of a key are never in one place.
    """
    w, x = F.col(weight).cast("double"), F.col(value)
    rows = df.withColumn("__bin", F.floor(x / bin_width).cast("bigint"))
    order = [value, tie]
    summed = running_sum(rows, key=key, chunk="__bin", order=order, sums={"__w": w, "__wx": w * x, "__wxx": w * x * x})
    ahead = neighbours(summed, key=key, chunk="__bin", order=order, following={"__next": value})
    totals = df.groupBy(*key).agg(F.sum(w).alias("__all_w"), F.sum(w * x).alias("__all_wx"), F.sum(w * x * x).alias("__all_wxx"))
    cuts = ahead.where("NOT is_last").join(totals, list(key))
    lo_w, hi_w = F.col("__w"), F.col("__all_w") - F.col("__w")
    lo_m, hi_m = F.col("__wx") / lo_w, (F.col("__all_wx") - F.col("__wx")) / hi_w
    spread = lambda xx, wx, w: F.greatest(F.lit(0.0), xx - wx * wx / w)
    pooled = F.sqrt((spread(F.col("__wxx"), F.col("__wx"), lo_w) + spread(F.col("__all_wxx") - F.col("__wxx"), F.col("__all_wx") - F.col("__wx"), hi_w)) / F.col("__all_w"))
    scored = cuts.select(
        *key, (F.pow(hi_m - lo_m, F.lit(2.0)) * lo_w * hi_w).alias("between"), (hi_m - lo_m).alias("delta"), pooled.alias("pooled"),
        lo_w.alias("lo_weight"), hi_w.alias("hi_weight"), x.alias("lo_edge"), F.col("__next").alias("hi_edge"),
    )
    pick = F.struct("delta", "pooled", "lo_weight", "hi_weight", "lo_edge", "hi_edge")
    best = scored.groupBy(*key).agg(F.max_by(pick, F.struct("between", (-F.col("lo_edge")).alias("e"))).alias("b")).select(*key, "b.*")
    dprime = F.col("delta") / F.greatest(F.col("pooled"), F.lit(V.POOLED_SD_FLOOR))
    return best.select(
        *key, ((F.col("lo_edge") + F.col("hi_edge")) / 2).alias("cut"), (F.col("hi_edge") - F.col("lo_edge")).alias("gap"), "delta",
        dprime.alias("dprime"), "lo_weight", "hi_weight",
        ((F.col("delta") >= V.MIN_PITCH_DELTA_ST) & (dprime >= V.MIN_DPRIME)
         & (F.least("lo_weight", "hi_weight") / 100.0 >= V.MIN_SECOND_VOICE_S)).alias("accepted"),
    )


# ------------------------------------------------------------- phrase level


def measured_phrases(words: DataFrame, frames: DataFrame, hop_ms: float) -> DataFrame:
    """Phrases with their voiced frames, pitch (semitones) and level."""
    return measured_spans(C.phrase_spans(C.phrases(words)), frames, hop_ms)


def measured_spans(phrase_spans: DataFrame, frames: DataFrame, hop_ms: float) -> DataFrame:
    """``measured_phrases`` for phrases that were found already."""
    spans = phrase_spans.select("call_id", "phrase_id", "chunk", "start_ms", "end_ms")
    feats = span_features(frames, spans, span_key=["call_id", "phrase_id"], hop_ms=hop_ms)
    return feats.withColumn("pitch", semitones("f0_median")).select(
        "call_id", "phrase_id", "chunk", "start_ms", "end_ms", "frames", "pitch", "level_db"
    )


def foreground(phrase_rows: DataFrame) -> DataFrame:
    """Adds reliable / quiet / fg: quiet phrases lie far below the median level of the reliable ones."""
    reliable = F.col("pitch").isNotNull() & (F.col("frames") >= V.RELIABLE_PHRASE_FRAMES)
    rows = phrase_rows.withColumn("reliable", reliable)
    levels = rows.where("reliable").withColumn("__l", F.coalesce("level_db", F.lit(-100.0)))
    med = nearest_rank_by(levels, ["call_id"], "__l", {"med_level": 0.5}, width=1.0)
    n = rows.groupBy("call_id").agg(F.count_if("reliable").alias("n_reliable"))
    quiet = (
        (F.col("n_reliable") >= 3) & F.col("level_db").isNotNull() & (F.col("frames") >= V.BACKGROUND_MIN_FRAMES)
        & (F.col("level_db") < F.col("med_level") - V.BACKGROUND_DB)
    )
    joined = rows.join(n, "call_id").join(med, "call_id", "left").withColumn("quiet", F.coalesce(quiet, F.lit(False)))
    return joined.withColumn("fg", F.col("reliable") & ~F.col("quiet")).drop("med_level")


def voice_groups(fg_phrases: DataFrame, settle=lambda df: df) -> DataFrame:
    """Per call and pitch group: centre, spread and first start. One group (0) where no split is accepted."""
    fg = fg_phrases.where("fg").select("call_id", "phrase_id", "pitch", "frames", "start_ms")
    split = two_groups(fg, key=["call_id"], value="pitch", weight="frames", tie="phrase_id")
    enough = fg.groupBy("call_id").agg((F.count("*") >= 3).alias("enough"))
    ok = settle(split.join(enough, "call_id").where("accepted AND enough").select("call_id", "cut", "delta"))
    grouped = fg.join(ok, "call_id", "left").withColumn(
        "grp", F.when(F.col("cut").isNotNull() & (F.col("pitch") >= F.col("cut")), 1).otherwise(0)
    )
    centre = nearest_rank_by(grouped, ["call_id", "grp"], "pitch", {"centre": 0.5}, width=0.25)
    spread = grouped.join(centre, ["call_id", "grp"]).groupBy("call_id", "grp").agg(
        F.max("centre").alias("centre"), F.greatest(F.lit(V.VOICE_SIGMA_FLOOR), F.sqrt(F.avg(F.pow(F.col("pitch") - F.col("centre"), F.lit(2.0))))).alias("sigma"),
        F.min("start_ms").alias("first_start"), F.max("delta").alias("delta"), F.max("cut").alias("cut"),
    )
    return spread


def voices_per_call(groups: DataFrame) -> DataFrame:
    """One row per call: centres and spreads in order of first appearance."""
    pack = F.array_sort(F.collect_list(F.struct("first_start", "grp", "centre", "sigma")))  # at most two
    return groups.groupBy("call_id").agg(
        pack.alias("v"), F.max("delta").alias("delta"), F.max("cut").alias("cut"),
    ).select(
        "call_id", F.size("v").alias("groups"), F.transform("v", lambda x: x["centre"]).alias("centres"),
        F.transform("v", lambda x: x["sigma"]).alias("sigmas"), "delta", "cut",
    )


def background_words(numbered: DataFrame, fg_phrases: DataFrame, voices: DataFrame) -> DataFrame:
    """(word key) of words in quiet phrases whose pitch matches none of the call's voices."""
    quiet = fg_phrases.where("quiet").join(voices.select("call_id", "centres"), "call_id", "left")
    known = F.exists(F.coalesce("centres", F.array().cast("array<double>")), lambda c: F.abs(c - F.col("pitch")) < V.SAME_VOICE_ST)
    lone = quiet.where(F.col("pitch").isNull() | ~known).select("call_id", "phrase_id")
    return numbered.join(lone, ["call_id", "phrase_id"], "left_semi").select(*WORD)


# --------------------------------------------------------------- word level


def word_costs(words: DataFrame, frames: DataFrame, voices: DataFrame, hop_ms: float) -> DataFrame:
    """Cost of each of the two voices for every word with enough voiced frames (two-voice calls only)."""
    two = voices.where("groups = 2")
    spans = words.where(C.is_timed()).join(two.select("call_id"), "call_id", "left_semi")
    feats = span_features(frames, spans.select(*WORD, "start_ms", "end_ms"), span_key=WORD, hop_ms=hop_ms)
    measured = feats.where((F.col("frames") >= V.WORD_MIN_FRAMES) & F.col("f0_median").isNotNull())
    weight = F.least(F.lit(1.0), F.col("frames") / V.WORD_FULL_WEIGHT_FRAMES)
    cost = lambda k: weight * F.pow((semitones("f0_median") - F.col("centres")[k]) / F.col("sigmas")[k], F.lit(2.0))
    costs = measured.join(two, "call_id").select(*WORD, cost(0).alias("c0"), cost(1).alias("c1"))
    return words.join(costs, WORD)


def smooth_two_voices(costed: DataFrame, settle=lambda df: df) -> DataFrame:
    """Cheapest label path over the words of each call (0/1), a switch being cheaper at pauses and sentence ends.

    A chunk is first reduced to the 2x2 matrix of path costs from entry label
    to exit label; chaining the matrices gives every chunk its exact entry
    costs. Each chunk then traces both possible paths and a backward chain
    picks the one that continues. Ties stay with the current label. Words may come
    without their text if ``__stop`` says whether a sentence ends with them.
    """
    marked = costed if "__stop" in costed.columns else costed.withColumn("__stop", C.ends_sentence("word"))
    near = neighbours(marked, key=["call_id"], chunk="chunk", order=["turn", "pos"], previous={"__end": "end_ms", "__stopped": "__stop"})
    easy = (F.col("start_ms") - F.col("__end") >= V.SWITCH_PAUSE_S * 1000) | F.col("__stopped")
    switch = F.when(F.col("is_first"), F.lit(-1.0)).when(easy, V.SWITCH_COST * V.SWITCH_DISCOUNT).otherwise(V.SWITCH_COST)
    steps = near.select("call_id", "chunk", F.struct("turn", "pos", "c0", "c1", switch.alias("sw")).alias("s"))
    packed = settle(steps.groupBy(F.col("call_id").alias("key"), "chunk").agg(F.array_sort(F.collect_list("s")).alias("s")))
    key_type = costed.schema["call_id"].dataType.simpleString()

    def forward(items, a0: float, a1: float):
        """Costs after the last item and the origin of each label at every item."""
        back = np.zeros((len(items), 2), dtype=np.int8)
        for i, it in enumerate(items):
            sw = it["sw"]
            if sw < 0:  # first measured word of the call
                n0, n1 = 0.0, 0.0
                back[i] = (0, 1)
            else:
                m0, m1 = a1 + sw, a0 + sw
                n0, back[i, 0] = (m0, 1) if m0 < a0 else (a0, 0)
                n1, back[i, 1] = (m1, 0) if m1 < a1 else (a1, 1)
            a0, a1 = n0 + it["c0"], n1 + it["c1"]
        return a0, a1, back

    inf = float("inf")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c, items in zip(b["key"], b["chunk"], b["s"]):
                p, r = forward(items, 0.0, inf), forward(items, inf, 0.0)
                rows.append((k, c, p[0], p[1], r[0], r[1]))
            yield pd.DataFrame(rows, columns=["key", "chunk", "m00", "m01", "m10", "m11"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a0, a1 = 0.0, 0.0
        for b in batches:
            rows = []
            for k, c, m00, m01, m10, m11 in b[["key", "chunk", "m00", "m01", "m10", "m11"]].itertuples(index=False):
                rows.append((k, c, a0, a1))
                a0, a1 = min(a0 + m00, a1 + m10), min(a0 + m01, a1 + m11)
            yield pd.DataFrame(rows, columns=["key", "chunk", "a0", "a1"])

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c, items, a0, a1 in zip(b["key"], b["chunk"], b["s"], b["a0"], b["a1"]):
                e0, e1, back = forward(items, a0, a1)
                paths, entry = [], []
                for label in (0, 1):
                    path = np.zeros(len(items), dtype=np.int64)
                    at = label
                    for i in range(len(items) - 1, -1, -1):
                        path[i] = at
                        at = int(back[i, at])
                    paths.append(path.tolist())
                    entry.append(at)
                words = [{"turn": it["turn"], "pos": it["pos"]} for it in items]
                rows.append((k, c, words, paths[0], paths[1], entry[0], entry[1], 1 if e1 < e0 else 0))
            yield pd.DataFrame(rows, columns=["key", "chunk", "w", "p0", "p1", "e0", "e1", "best"])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label = None
        for b in batches:
            rows = []
            for k, c, e0, e1, best in b[["key", "chunk", "e0", "e1", "best"]].itertuples(index=False):
                label = best if label is None else label
                rows.append((k, c, label))
                label = e1 if label == 1 else e0
            yield pd.DataFrame(rows, columns=["key", "chunk", "label"])

    mats = packed.mapInPandas(matrices, f"key {key_type}, chunk bigint, m00 double, m01 double, m10 double, m11 double")
    entries = per_key_stream(mats.repartition("key").sortWithinPartitions("key", "chunk"), chain, f"key {key_type}, chunk bigint, a0 double, a1 double")
    traced = settle(packed.join(entries, ["key", "chunk"]).mapInPandas(
        trace, f"key {key_type}, chunk bigint, w array<struct<turn:bigint,pos:bigint>>, p0 array<int>, p1 array<int>, e0 int, e1 int, best int"))
    release(packed)
    ends = traced.select("key", "chunk", "e0", "e1", "best").repartition("key").sortWithinPartitions("key", F.desc("chunk"))
    picked = per_key_stream(ends, choose, f"key {key_type}, chunk bigint, label int")
    path = F.when(F.col("label") == 1, F.col("p1")).otherwise(F.col("p0"))
    both = traced.join(picked, ["key", "chunk"]).select("key", F.inline(F.arrays_zip(F.col("w").alias("w"), path.alias("voice"))))
    return both.select(F.col("key").alias("call_id"), "w.turn", "w.pos", "voice")


def repair_short_runs(labelled: DataFrame) -> DataFrame:
    """Relabels runs of one or two words between two runs of the other voice when no pause surrounds them.

    Runs are built per chunk; only runs, not words, are read in order per call,
    with two of them in memory. A repaired run merges its neighbours, so every
    later glitch is judged against the merged run.
    """
    runs = islands(
        labelled, key=["call_id"], chunk="chunk", order=["turn", "pos"], uses=["voice"],
        starts=lambda cur, prev: cur("voice") != prev("voice"), name="run_id",
    )
    at = F.struct("turn", "pos")
    table = runs.groupBy(F.col("call_id").alias("key"), "run_id").agg(
        F.min("voice").alias("voice"), F.count("*").alias("n"), F.min_by("start_ms", at).alias("lo"), F.max_by("end_ms", at).alias("hi")
    )
    limit = V.REPAIR_GAP_S * 1000

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = cur = None
        for b in batches:
            fixed = []
            for row in b[["key", "run_id", "voice", "n", "lo", "hi"]].itertuples(index=False):
                if prev is None:
                    prev = row
                elif cur is None:
                    cur = row
                elif cur.n <= V.REPAIR_MAX_RUN and prev.voice == row.voice and cur.lo - prev.hi < limit and row.lo - cur.hi < limit:
                    fixed.append((cur.key, cur.run_id, prev.voice))
                    prev, cur = row._replace(n=prev.n + cur.n + row.n, lo=prev.lo), None
                else:
                    prev, cur = cur, row
            yield pd.DataFrame(fixed, columns=["key", "run_id", "voice"])

    key_type = labelled.schema["call_id"].dataType.simpleString()
    ordered = table.repartition("key").sortWithinPartitions("key", "run_id")
    fixes = per_key_stream(ordered, scan, f"key {key_type}, run_id bigint, voice int")
    new = fixes.select(F.col("key").alias("call_id"), "run_id", F.col("voice").alias("__new"))
    out = runs.join(new, ["call_id", "run_id"], "left")
    return out.select(
        *[c for c in labelled.columns if c not in ("voice", "attribution")], F.coalesce("__new", "voice").alias("voice"),
        F.when(F.col("__new").isNotNull(), 0.5).otherwise(F.col("attribution")).alias("attribution"),
    )


def fill_from_nearest(words: DataFrame, *, label: str = "voice", confidence: str = "attribution") -> DataFrame:
    """Unlabelled words take the label of the nearest labelled word (earlier wins a tie), confidence at most 0.55."""
    indexed = running_sum(words, key=["call_id"], chunk="chunk", order=["turn", "pos"], sums={"__i": F.lit(1).cast("bigint")})
    has = F.col(label).isNotNull() & ~F.col("background")
    carry = {"__{}_label": label, "__{}_conf": confidence, "__{}_i": "__i"}
    near = neighbours(
        indexed, key=["call_id"], chunk="chunk", order=["turn", "pos"], among=has,
        previous={k.format("p"): v for k, v in carry.items()}, following={k.format("n"): v for k, v in carry.items()},
    )
    use_prev = F.col("__p_i").isNotNull() & (F.col("__n_i").isNull() | (F.col("__i") - F.col("__p_i") <= F.col("__n_i") - F.col("__i")))
    filled = F.when(use_prev, F.col("__p_label")).otherwise(F.col("__n_label"))
    conf = F.least(F.lit(0.55), F.when(use_prev, F.col("__p_conf")).otherwise(F.col("__n_conf")))
    gets = F.col(label).isNull() & ~F.col("background")
    return near.select(
        *[c for c in words.columns if c not in (label, confidence)],
        F.when(gets, filled).otherwise(F.col(label)).alias(label), F.when(gets, F.coalesce(conf, F.lit(0.0))).otherwise(F.col(confidence)).alias(confidence),
    )


def number_by_first_appearance(words: DataFrame, label: str = "voice") -> DataFrame:
    """Voice 0 is the one that speaks first."""
    first = words.where(F.col(label).isNotNull()).groupBy("call_id").agg(F.min_by(label, F.struct("turn", "pos")).alias("__first"))
    swapped = F.when(F.col("__first") == 1, 1 - F.col(label)).otherwise(F.col(label))
    return words.join(first, "call_id", "left").withColumn(label, swapped).withColumn("__swap", F.col("__first") == 1).drop("__first")


def recogniser_agreement(words: DataFrame) -> DataFrame:
    """Best agreement of recogniser labels with the two voices, over all label mappings."""
    both = words.where("recognised IS NOT NULL AND voice IS NOT NULL").groupBy("call_id", "recognised").agg(
        F.count_if(F.col("voice") == 0).alias("n0"), F.count_if(F.col("voice") == 1).alias("n1"))
    call = W.partitionBy("call_id")  # one row per recogniser label
    share = (F.col("n0") + F.sum("n1").over(call) - F.col("n1")) / F.sum(F.col("n0") + F.col("n1")).over(call)
    return both.select("call_id", share.alias("a")).groupBy("call_id").agg(F.max(F.greatest(F.col("a"), 1 - F.col("a"))).alias("agreement"))


def attribute(words: DataFrame, frames: DataFrame, hop_ms: float, settle=settle, carry: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(words with voice, attribution and background; summary per call).

    ``words`` carries the recogniser's label as ``recognised`` (null = none).
    ``settle`` cuts the lineage of tables that several later steps read; without it the plan would repeat them, and a plan that
    holds the same steps tens of times takes the driver more memory than its rows. Settled tables hold the columns that are read
    again, and are deleted after the step that reads them last. ``frames`` are read twice and should be dealt by (call_id, frame_slot),
    which a settled table is not. ``carry``: columns of ``words`` that the result keeps besides the word key; all where it is not given.
    """
    kept = [c for c in words.columns if c not in WORD] if carry is None else list(carry)
    own = [c for c in words.columns if c in {"call_id", "chunk", "turn", "pos", "word", "start_ms", "end_ms", "recognised", *kept}]
    numbered = settle(C.phrases(words.select(*own)).withColumn("__stop", C.ends_sentence("word")).drop(*{"word"}.difference(kept)))
    measured = settle(measured_spans(C.phrase_spans(numbered), frames, hop_ms))
    fg = settle(foreground(measured))
    release(measured)
    voices = settle(voices_per_call(voice_groups(fg, settle)))
    lone = settle(background_words(numbered, fg, voices))
    flagged = numbered.drop("phrase_id").join(lone.withColumn("background", F.lit(True)), WORD, "left").withColumn("background", F.coalesce("background", F.lit(False)))

    timed = ["chunk", "start_ms", "end_ms"]
    heard = flagged.where("NOT background").select(*WORD, *timed, "__stop")
    costed = settle(word_costs(heard, frames, voices, hop_ms))
    margin = F.abs(F.col("c0") - F.col("c1")) / (F.col("c0") + F.col("c1") + 1e-9)
    labelled = settle(costed.join(smooth_two_voices(costed, settle), WORD).select(
        *WORD, *timed, "voice", half_up(F.least(F.lit(0.98), F.lit(0.5) + margin), 2).alias("attribution")))
    release(costed)
    repaired = settle(repair_short_runs(labelled).select(*WORD, "voice", "attribution"))
    release(labelled)

    summary_in = voices.select("call_id", "groups", "centres", "delta")
    known = words.groupBy("call_id").agg(F.count_distinct("recognised").alias("recogniser_speakers"))
    calls = known.join(summary_in, "call_id", "left").join(fg.groupBy("call_id").agg(F.count_if("reliable").alias("n_reliable")), "call_id", "left")
    info = settle(calls.select(
        "call_id", "recogniser_speakers", "delta", "centres", F.coalesce("n_reliable", F.lit(0)).alias("n_reliable"),
        (F.coalesce("groups", F.lit(0)) == 2).alias("two_voices"),
    ))
    two, many = F.col("two_voices"), F.col("recogniser_speakers") >= 2
    own_voice = F.when(many, F.col("recognised").cast("int")).otherwise(F.lit(0))
    sure = F.when(many, F.when(F.col("recognised").isNull(), 0.0).otherwise(0.45)).otherwise(F.when(F.col("n_reliable") >= 3, 0.9).otherwise(0.6))
    joined = settle(
        flagged.join(repaired, WORD, "left").join(info.select("call_id", "two_voices", "recogniser_speakers", "n_reliable"), "call_id")
        .select(*dict.fromkeys([*(c for c in words.columns if c in {*WORD, *kept}), "chunk", "recognised", "background"]), "two_voices",
                F.when(two, F.col("voice")).otherwise(own_voice).alias("voice"), F.when(two, F.col("attribution")).otherwise(sure).alias("attribution")))
    release(numbered, fg, voices, lone, repaired)
    every = settle(fill_from_nearest(joined.where("two_voices")).unionByName(joined.where("NOT two_voices")))
    release(joined)
    out = number_by_first_appearance(every.where("two_voices")).unionByName(every.where("NOT two_voices").withColumn("__swap", F.lit(False)))
    hide = lambda c, v: F.when(F.col("background"), F.lit(v)).otherwise(F.col(c))
    out = out.withColumns({"voice": hide("voice", None), "attribution": hide("attribution", 0.0)})
    words_out = out.select(*(c for c in words.columns if c in {*WORD, *kept}), "background", "voice", "attribution")

    agreed = recogniser_agreement(out.where("two_voices"))
    swaps = out.groupBy("call_id").agg(F.bool_or(F.coalesce("__swap", F.lit(False))).alias("swap"))
    return words_out, attribution_summary(info.join(agreed, "call_id", "left").join(swaps, "call_id", "left"))


def attribution_summary(info: DataFrame) -> DataFrame:
    """Number of voices, where that comes from, typical pitch, agreement, notes and reliability per call."""
    two, many = F.col("two_voices"), F.col("recogniser_speakers") >= 2
    agreed = many & (F.coalesce("agreement", F.lit(0.0)) >= 0.85)
    source = F.when(two & agreed, "recognizer+acoustic").when(two, "acoustic").when(many, "recognizer").otherwise("single_voice")
    speakers = F.when(two, 2).when(many, F.col("recogniser_speakers")).otherwise(1)
    hz = F.transform("centres", lambda c: semitones_to_hz(c).cast("int"))
    pct = half_up(F.coalesce("agreement", F.lit(0.0)) * 100).cast("bigint").cast("string")
    # fixed values: wording of the notes
    notes = F.array_compact(F.array(
        F.when(two & (F.col("recogniser_speakers") < 2), F.lit("The speech recogniser reported one speaker; two distinct voices were found in the audio itself.")),
        F.when(two & many & ~agreed, F.concat(F.lit("The recogniser's speaker labels agree with the audio only "), pct, F.lit("% of the time, so the acoustic labels were used."))),
        F.when(~two & many, F.concat(F.lit("The speech recogniser reported "), F.col("recogniser_speakers").cast("string"), F.lit(" speakers but the audio shows one consistent pitch, so its labels are kept but marked uncertain. Two voices with a similar pitch cannot be told apart from the audio alone."))),
        F.when(~two & ~many & (F.col("n_reliable") < 3), F.lit("Too little clear speech to compare voices, so a single speaker is assumed.")),
    ))
    return info.select(
        "call_id", speakers.cast("int").alias("speakers"), source.alias("source"), source.isin(*V.RELIABLE_SOURCES).alias("reliable"),
        F.when(two, half_up("delta", 1)).alias("pitch_gap_semitones"),
        F.when(two, F.when(F.coalesce("swap", F.lit(False)), F.reverse(hz)).otherwise(hz)).when(many | F.col("centres").isNull(), F.array().cast("array<int>")).otherwise(hz).alias("voice_pitch_hz"),
        "recogniser_speakers", F.when(two & many, half_up("agreement", 2)).alias("agreement"), notes.alias("notes"),
    )


def without_audio(words: DataFrame) -> DataFrame:
    """Attribution when a call has no frames: recogniser labels only, unverified."""
    return words.withColumns({
        "voice": F.col("recognised").cast("int"), "attribution": F.when(F.col("recognised").isNull(), 0.0).otherwise(0.5), "background": F.lit(False),
    })


def unheard_summary(calls: DataFrame, words: DataFrame) -> DataFrame:
    """The summary of calls without frames, like ``attribution_summary``: of labelled, of unlabelled and of no words at all. ``calls``: (call_id)."""
    known = words.groupBy("call_id").agg(F.count_distinct("recognised").alias("n"), F.lit(True).alias("worded"))
    labelled = F.coalesce("n", F.lit(0)) > 0
    # fixed values: wording of the notes
    note = F.when(F.col("worded"), "Audio could not be analysed, so speaker labels come from the speech recogniser only and were not verified.").otherwise(
        "This transcript has no word timings, so speakers could not be separated.")
    source = F.when(labelled, "recognizer").otherwise("unavailable")
    return calls.select("call_id").distinct().join(known, "call_id", "left").select(
        "call_id", F.when(labelled, F.col("n")).when(F.col("worded"), 1).otherwise(0).cast("int").alias("speakers"), source.alias("source"),
        source.isin(*V.RELIABLE_SOURCES).alias("reliable"), F.lit(None).cast("double").alias("pitch_gap_semitones"), F.array().cast("array<int>").alias("voice_pitch_hz"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("recogniser_speakers"), F.lit(None).cast("double").alias("agreement"), F.array(note).alias("notes"),
    )


def attribute_calls(calls: DataFrame, words: DataFrame, frames: DataFrame, hop_ms: float) -> tuple[DataFrame, DataFrame]:
    """``attribute`` for the calls that have frames and words, recogniser labels for the others: (words, summary of every call)."""
    heard = settle(frames.select("call_id").distinct().join(words.select("call_id").distinct(), "call_id", "left_semi"))
    voiced_words, summary = attribute(words.join(heard, "call_id", "left_semi"), frames, hop_ms)
    rest = words.join(heard, "call_id", "left_anti")
    others = without_audio(rest)
    return voiced_words.unionByName(others.select(*[F.col(c).cast(voiced_words.schema[c].dataType).alias(c) for c in voiced_words.columns])), summary.unionByName(
        unheard_summary(calls.join(heard, "call_id", "left_anti"), rest))
