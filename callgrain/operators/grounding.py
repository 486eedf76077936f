"""Checking extracted values and fragments against what was said."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import redaction, spoken
from callgrain.functions.columns import col, in_set, let



def with_numbers(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the number set of a text column (the Arrow step runs once per text)."""
    spoken_ones = df.withColumn("__spoken", spoken.number_tokens(F.col(text)))
    return spoken_ones.withColumn(
        name, F.array_distinct(F.concat(spoken.written_numbers(text), F.col("__spoken"), spoken.ordinal_numbers(text)))
    ).drop("__spoken")


def with_value_numbers(values: DataFrame, value: str = "value") -> DataFrame:
    return values.withColumn("__spoken", spoken.number_tokens(F.col(value))).withColumn(
        "value_numbers", F.concat("__spoken", spoken.ordinal_numbers(value))
    ).drop("__spoken")


def with_value_in_text(df: DataFrame, value: str, text: str, name: str = "said") -> DataFrame:
    """Adds whether ``value`` occurs in ``text``; both number sets are made once per row, outside the expression."""
    rows = with_value_numbers(with_numbers(df, text, "__text_numbers"), value)
    said = spoken.grounded(F.col(value), F.col("value_numbers"), F.col(text), F.col("__text_numbers"))
    return rows.withColumn(name, said).drop("__text_numbers", "value_numbers")


def packed_values(values: DataFrame) -> DataFrame:
    """(call_id, values): the extracted values of a call as one array.

    A model answer carries at most eight values per key and five keys, so the
    array is short however long the call is.
    """
    return with_value_numbers(values).groupBy("call_id").agg(
        F.collect_set(F.struct("key", "value", "value_numbers")).alias("values")
    )


def said_by(values: DataFrame, turns: DataFrame) -> DataFrame:
    """(call_id, key, value, speaker, uncertain) for every turn in which a value occurs.

    Each turn meets its call's short value array; only hits become rows.
    """
    met = with_numbers(turns, "text", "text_numbers").join(packed_values(values), "call_id")
    hits = F.filter("values", lambda v: spoken.grounded(v["value"], v["value_numbers"], F.col("text"), F.col("text_numbers")))
    return met.select("call_id", "speaker", "uncertain", F.inline(hits)).drop("value_numbers")


def ground_entities(values: DataFrame, turns: DataFrame, transcripts: DataFrame, calls: DataFrame) -> DataFrame:
    """Bucket of every extracted value: dropped, unverified, customer or agent_stated.

    ``calls``: (call_id, customer, attribution_known); ``transcripts``: (call_id, transcript).
    """
    spoken_turns = said_by(values, turns).join(calls.select("call_id", "customer"), "call_id")
    mine = F.col("speaker").eqNullSafe(F.col("customer"))
    who = spoken_turns.groupBy("call_id", "key", "value").agg(
        F.bool_or(mine).alias("by_customer"), F.bool_or(~mine).alias("by_others"), F.bool_and("uncertain").alias("only_uncertain")
    )
    whole = with_numbers(transcripts, "transcript", "text_numbers")
    judged = with_value_numbers(values).join(whole, "call_id", "left").join(calls, "call_id", "left").join(who, ["call_id", "key", "value"], "left")
    present = F.coalesce(spoken.grounded(F.col("value"), F.col("value_numbers"), F.col("transcript"), F.col("text_numbers")), F.lit(False))
    no = F.lit(False)
    bucket = (
        F.when(~present, "dropped")
        .when(~F.coalesce("attribution_known", no) | F.col("customer").isNull(), "unverified")
        .when(F.coalesce("only_uncertain", no), "unverified")
        .when(F.coalesce("by_customer", no), "customer")
        .when(F.coalesce("by_others", no), "agent_stated")
        .otherwise("unverified")
    )
    return judged.select("call_id", "key", "value", bucket.alias("bucket"))


def ground_corrections(corrections: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Keeps a correction only when both its values were said. Adds ``kept``."""
    rows = with_numbers(transcripts, "transcript", "text_numbers").join(corrections, "call_id", "right")
    for side in ("original", "corrected"):
        rows = rows.withColumn("__spoken", spoken.number_tokens(F.col(side))).withColumn(
            f"__{side}", F.concat("__spoken", spoken.ordinal_numbers(side)))
    said = lambda c: F.coalesce(spoken.grounded(F.col(c), F.col(f"__{c}"), F.col("transcript"), F.col("text_numbers")), F.lit(False))
    return rows.select(*corrections.columns, (said("original") & said("corrected")).alias("kept"))


def undetected_corrections(found: DataFrame, known: DataFrame) -> DataFrame:
    """Spotted corrections whose digits match no known correction (same pair, or same corrected value)."""
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    listed = known.select("call_id", digits(F.col("corrected")).alias("__to")).distinct()
    return found.withColumn("__to", digits(F.col("corrected"))).join(listed, ["call_id", "__to"], "left_anti").drop("__to")


def ground_fragments(fragments: DataFrame, texts: DataFrame, *, gram: int = 3, few: int = 1000) -> DataFrame:
    """(fragment_id, text_id) pairs: the normalised fragment (four characters or more) occurs in the normalised text.

    A fragment of ``gram`` + 2 words or more has inner words that must occur
    as whole words in the text, so it is looked up by one inner word group (the
    longest one, as long words are rare) and then verified. Shorter fragments
    have no such anchor: up to ``few`` are broadcast and tested against every
    text, more are looked up by their first four characters, or fewer where
    normalising leaves fewer. Both ways give the same pairs.
    """
    pieces = fragments.where(F.length(F.trim("fragment")) >= 4).select("fragment_id", spoken.plain("fragment").alias("f"))
    pieces = pieces.withColumn("w", F.split("f", " "))
    long = F.size("w") >= gram + 2
    docs = texts.select("text_id", spoken.plain("text").alias("t"))
    # coalesce keeps Spark from adding a filter on not-null texts, which would normalise each of them once more
    inside = lambda text: F.coalesce(text.contains(F.col("f")), F.lit(False))

    def grams(words: Column, skip: int) -> Column:
        """Hashes of the word groups of a text, without the first and last ``skip`` words."""
        def hashed(ws: Column) -> Column:
            count = F.size(ws) - gram + 1 - 2 * skip
            at = F.when(count > 0, F.sequence(F.lit(1 + skip), count + skip)).otherwise(F.array().cast("array<int>"))
            return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.element_at(ws, i + k) for k in range(gram)])))

        return let(words, hashed)

    def anchor(words: Column) -> Column:
        def longest(ws: Column) -> Column:
            at = F.sequence(F.lit(2), F.size(ws) - gram)
            sized = F.transform(at, lambda i: F.struct(
                F.length(F.array_join(F.slice(ws, i, gram), "")).alias("n"), F.xxhash64(*[F.element_at(ws, i + k) for k in range(gram)]).alias("g")))
            return F.array_max(sized)["g"]

        return let(words, longest)

    anchored = pieces.where(long).select("fragment_id", "f", anchor(F.col("w")).alias("g"))
    seen = docs.select("text_id", F.explode(grams(F.split("t", " "), 0)).alias("g"))
    # few texts are candidates: they are normalised after the join, the others are not
    candidates = seen.join(anchored, "g").select("fragment_id", "text_id", "f").join(texts.select("text_id", "text"), "text_id")
    found = candidates.where(inside(spoken.plain("text"))).select("fragment_id", "text_id")

    short = pieces.where(~long).select("fragment_id", "f")
    if short.limit(few + 1).count() <= few:
        direct = docs.join(F.broadcast(short), inside(F.col("t")))
    else:
        # the empty fragment lies in every text and has the empty lead
        leads = docs.select("text_id", "t", F.explode(let(F.split("t", ""), _leads)).alias("g"))
        direct = leads.join(short.withColumn("g", F.substring("f", 1, 4)), "g").where(inside(F.col("t")))
    return found.unionByName(direct.select("fragment_id", "text_id"))


def _leads(letters: Column) -> Column:
    """Every different string of up to four of the letters in a row."""
    def of(n: int) -> Column:
        at = F.when(F.size(letters) >= n, F.sequence(F.lit(0), F.size(letters) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(*[F.get(letters, i + k) for k in range(n)]))

    return F.array_distinct(F.concat(F.array(F.lit("")), *[of(n) for n in (1, 2, 3, 4)]))


# -------------------------------------------------------------- model answers

ANSWER = """summary STRING, customer_speaker INT, issues ARRAY<STRUCT<label STRING, quote STRING>>,
 primary_intent STRUCT<label STRING, description STRING>, secondary_intents ARRAY<STRUCT<label STRING, description STRING>>, intent_confidence STRING,
 entities STRUCT<order_ids ARRAY<STRING>, transaction_ids ARRAY<STRING>, amounts ARRAY<STRING>, dates ARRAY<STRING>, other ARRAY<STRING>>,
 corrections ARRAY<STRUCT<field STRING, original STRING, corrected STRING>>, lexical_tone STRUCT<emotion STRING, valence STRING, intensity STRING, evidence STRING>,
 established_facts ARRAY<STRING>, ambiguities ARRAY<STRING>, repetitions ARRAY<STRING>, late_information ARRAY<STRING>, off_topic_speech ARRAY<STRING>,
 next_steps ARRAY<STRING>, escalate BOOLEAN, _corrupt STRING"""


def clean_text(value: Column, limit: int = 400) -> Column:
    return F.substring(redaction.redact(F.trim(F.coalesce(value, F.lit("")))), 1, limit)


def clean_list(values: Column, cap: int, limit: int = 400) -> Column:
    kept = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: clean_text(v, limit)), lambda v: v != "")
    return F.slice(kept, 1, cap)


def allowed(value: Column, choices: Sequence[str], default: str) -> Column:
    return F.when(in_set(value, choices), value).otherwise(F.lit(default))


def clean_intent(value: Column) -> Column:
    return F.struct(allowed(value["label"], V.INTENTS, "other").alias("label"), clean_text(value["description"]).alias("description"))


def normalise_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Model answers with labels clamped to the vocabularies, texts redacted and cut, lists capped.

    Adds ``answer_error`` for text that is not readable JSON.
    """
    read = answers.withColumn("a", F.from_json(raw, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("a").isNull() | F.col("a._corrupt").isNotNull()
    corr = F.transform(F.slice(F.coalesce("a.corrections", F.array().cast("array<struct<field:string,original:string,corrected:string>>")), 1, 8), lambda c: F.struct(
        clean_text(c["field"], 80).alias("field"), clean_text(c["original"], 120).alias("original"), clean_text(c["corrected"], 120).alias("corrected")))
    tone = F.col("a.lexical_tone")
    keep = [c for c in answers.columns if c != raw]
    return read.select(
        *keep, F.when(broken, F.lit("the model did not return readable JSON")).alias("answer_error"),
        clean_text(F.col("a.summary"), 700).alias("summary"), (F.col("a.customer_speaker") - 1).alias("declared_speaker"),
        clean_intent(F.col("a.primary_intent")).alias("primary_intent"),
        F.transform(F.coalesce("a.secondary_intents", F.array().cast("array<struct<label:string,description:string>>")), clean_intent).alias("listed_intents"),
        F.transform(F.coalesce("a.issues", F.array().cast("array<struct<label:string,quote:string>>")), lambda i: F.struct(
            allowed(i["label"], V.INTENTS, "other").alias("label"), clean_text(i["quote"]).alias("description"))).alias("issue_intents"),
        allowed(F.col("a.intent_confidence"), V.LEVELS, "medium").alias("intent_confidence"),
        F.struct(*[clean_list(F.col(f"a.entities.{k}"), 8).alias(k) for k in V.ENTITY_KEYS]).alias("entities"),
        F.filter(corr, lambda c: (c["original"] != "") | (c["corrected"] != "")).alias("corrections"),
        F.struct(
            allowed(tone["emotion"], V.EMOTIONS, "not_evident").alias("emotion"), allowed(tone["valence"], V.VALENCES, "unclear").alias("valence"),
            allowed(tone["intensity"], V.LEVELS, "low").alias("intensity"), clean_text(tone["evidence"], 240).alias("evidence")).alias("lexical_tone"),
        *[clean_list(F.col(f"a.{name}"), cap).alias(name) for name, cap in (
            ("established_facts", 10), ("ambiguities", 6), ("repetitions", 5), ("late_information", 5), ("off_topic_speech", 5), ("next_steps", 5))],
        F.coalesce("a.escalate", F.lit(False)).alias("escalate"),
    )


def merged_intents(primary_label: Column, listed: Column, from_issues: Column, cap: int = 6) -> Column:
    """Listed intents, then intents of quoted issues; first of each label, without the primary one."""
    both = F.concat(listed, from_issues)
    labels = F.transform(both, lambda x: x["label"])
    first = F.filter(F.zip_with(both, F.sequence(F.lit(1), F.size(both)), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                     lambda p: (F.array_position(labels, p["x"]["label"]) == p["i"]) & (p["x"]["label"] != primary_label))
    return F.when(F.size(both) == 0, both).otherwise(F.slice(F.transform(first, lambda p: p["x"]), 1, cap))


def merged_ambiguities(stated: Column, spotted: Column, cap: int = 8) -> Column:
    return F.slice(F.concat(stated, spotted), 1, cap)


def customer_of(declared: str | Column, speakers: str | Column, first_speaker: str | Column, known_speakers: Column) -> Column:
    """Only voice of a one-voice call, else the declared speaker when it speaks in the call."""
    single = F.coalesce(col(first_speaker), F.lit(0))
    return F.when(col(speakers) <= 1, single).when(F.array_contains(known_speakers, col(declared)), col(declared))
