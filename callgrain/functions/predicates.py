"""Reusable row predicates and rule chains over the call ledger."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import col, in_set, lookup


def finished(status: str | Column = "status") -> Column:
    return in_set(status, V.FINISHED)


def in_flight(status: str | Column = "status") -> Column:
    return in_set(status, V.IN_FLIGHT)


def truth_label() -> Column:
    """Injected fault, or 'ok' for a deliberate clean call."""
    return F.coalesce(F.col("injected_fault"), F.lit("ok"))


def has_ground_truth() -> Column:
    labelled = F.col("injected_fault").isNotNull() | (F.col("label_source") == "control")
    return finished() & F.col("predicted_category").isNotNull() & labelled


def healthy_call() -> Column:
    return finished() & F.col("injected_fault").isNull()


def measured_stage() -> Column:
    return in_set("stage", V.MAIN_STAGES) & F.col("duration_ms").isNotNull()


def cause() -> Column:
    """Displayed cause: category of a failed call, 'unknown' when the category says nothing."""
    named = F.when(F.col("predicted_category") != "ok", F.col("predicted_category"))
    return F.when(F.col("status") == "failed", F.coalesce(named, F.lit("unknown")))


def confidence_threshold(provider: str | Column) -> Column:
    return lookup(V.STT_MIN_CONFIDENCE_BY_PROVIDER, provider, V.STT_MIN_CONFIDENCE)


def below_threshold(avg_confidence: str | Column) -> Column:
    c = F.coalesce(col(avg_confidence), F.lit(0.0))
    return (c > 0) & (c < V.STT_MIN_CONFIDENCE)


def incoherent(text: str | Column) -> Column:
    """Empty, a single word, or less than half ASCII letters."""
    t = col(text)
    words = F.size(F.split(F.regexp_replace(t, r"^\s+|\s+$", ""), r"\s+"))
    letters = F.length(F.regexp_replace(t, "[^a-zA-Z]", ""))
    return (F.trim(t) == "") | (words < 2) | (letters / F.greatest(F.lit(1), F.length(t)) < 0.5)


def speech_length_mismatch(size_bytes: str | Column, seconds: str | Column, text_chars: str | Column) -> Column:
    """Reply audio missing, suspiciously small, or far from 15 characters per second."""
    actual = col(seconds) / (col(text_chars) / 15.0)
    judged = F.when(col(text_chars) == 0, F.lit(False)).otherwise((actual < 0.5) | (actual > 2.5))
    return F.when(col(size_bytes).isNull() | (col(size_bytes) < 1000), F.lit(True)).otherwise(judged)


# fixed values: wording of a reply that declines to answer
DECLINE_PATTERN = (
    r"(?i)\b(i['’]?m sorry|i am sorry|i can['’]?t|i cannot|i can not|i don['’]?t (?:have|know)|i do not (?:have|know)"
    r"|i['’]?m not (?:able|sure)|unable to|not able to|no (?:record|information) (?:of|about|on))\b"
)


def plain_decline(question: str | Column, reply: str | Column) -> Column:
    """The reply declines and brings no number the question did not contain."""
    said = F.regexp_extract_all(col(question), F.lit(r"(\d+)"), F.lit(1))
    replied = F.regexp_extract_all(col(reply), F.lit(r"(\d+)"), F.lit(1))
    return col(reply).rlike(DECLINE_PATTERN) & (F.size(F.array_except(replied, said)) == 0)


def tenant_key(raw: str | Column) -> Column:
    """Lower-cased tenant UUID (versions 1-8), null when malformed."""
    ok = col(raw).rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return F.when(ok, F.lower(col(raw)))


def audio_kind(file_name: str | Column, mime: str | Column) -> Column:
    """Audio extension from the file name, else from the MIME type, else null."""
    ext = F.lower(F.regexp_extract(F.coalesce(col(file_name), F.lit("")), r"\.([^.]*)$", 1))
    named = F.when(in_set(ext, V.AUDIO_EXTENSIONS), F.coalesce(lookup(V.EXTENSION_ALIASES, ext), ext))
    typed = lookup(V.MIME_EXTENSIONS, F.lower(F.trim(F.substring_index(F.coalesce(col(mime), F.lit("")), ";", 1))))
    return F.coalesce(named, typed)


def customer_voice(understood: str | Column, speakers: str | Column) -> Column:
    """Understood speaker; voice 0 when the call has one voice; else unknown."""
    return F.coalesce(col(understood), F.when(col(speakers) <= 1, F.lit(0)))


def turn_role(speaker: str | Column, customer: str | Column, speakers: str | Column) -> Column:
    return (
        F.when(F.coalesce(col(speakers), F.lit(1)) <= 1, F.lit("Caller"))
        .when(col(customer) == col(speaker), F.lit("Customer"))
        .when(col(customer).isNull(), F.concat(F.lit("Voice "), (col(speaker) + 1).cast("string")))
        .otherwise(F.lit("Other voice"))
    )
