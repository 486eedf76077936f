"""Removing personal data from text columns, in JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrain.functions.columns import col, let

# --- fixed values: the five patterns and their replacement tags -------------
# Word boundaries and blanks are spelled out so that accented letters and
# non-breaking spaces behave the same in every engine.
# Patterns start with the character that must be there, then look behind it,
# so most positions of a text fail on one comparison.
_W = "0-9A-Za-z_"
EDGE = f"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
BLANK = r"\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
DIGIT_WORD = "(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CARD = rf"\d(?<![{_W}]\d)[ -]?(?:\d[ -]?){{12,18}}{EDGE}"
SSN = rf"\d(?<![{_W}]\d)\d{{2}}-\d{{2}}-\d{{4}}(?![{_W}])"
SPOKEN = rf"(?i)(?=[zotfsen])(?<![{_W}]){DIGIT_WORD}(?:[{BLANK},-]+{DIGIT_WORD}){{9,}}(?![{_W}])"
PHONE = rf"\+?\(?\d[\d{BLANK}\-().]{{7,}}\d"
CARD_GROUPS = r"^\d{4}([ -]\d{4}){3}(\d{0,3})$"
TAGS = {
    "email": "[REDACTED_EMAIL]", "card": "[REDACTED_CARD]", "ssn": "[REDACTED_SSN]",
    "spoken": "[REDACTED_NUMBER]", "phone": "[REDACTED_PHONE]",
}
KINDS = tuple(TAGS)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def is_card(hit: Column) -> Column:
    """13-19 digits that pass the checksum or are written in groups of four."""
    d = digits(hit)
    return F.length(d).between(13, 19) & (F.call_function("luhn_check", d) | F.trim(hit).rlike(CARD_GROUPS))


def is_phone(hit: Column, strict: bool = False) -> Column:
    """At least ten digits in groups a phone number is written in.

    ``strict`` also refuses dotted quads, which otherwise pass as short groups.
    """
    groups = F.filter(F.split(hit, r"\D+"), lambda g: g != "")
    short = F.forall(groups, lambda g: F.length(g) <= 4)
    marked = F.regexp_replace(hit, f"^[{BLANK}]+", "").rlike(r"^[+(]")
    two = (F.size(groups) == 2) & (F.length(groups[0]) <= 4)
    ok = (F.length(digits(hit)) >= 10) & ~hit.rlike(f"[.,;][{BLANK}]") & ((F.size(groups) == 1) | short | marked | two)
    return ok & ~hit.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") if strict else ok


def replace_where(text: Column, pattern: str, keep: Callable[[Column], Column], tag: str) -> Column:
    """Replaces the matches of ``pattern`` for which the predicate holds.

    The text is cut at the matches and joined again; texts without a match
    (nearly all) skip that work.
    """
    def rebuilt(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        hits = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        swapped = F.transform(hits, lambda h: F.when(keep(h), F.lit(tag)).otherwise(h))
        joined = F.array_join(F.zip_with(gaps, swapped, lambda g, h: F.concat(g, F.coalesce(h, F.lit("")))), "")
        return F.when(t.rlike(pattern), joined).otherwise(t)

    return let(text, rebuilt)


def redact(text: str | Column, strict_phone: bool = False) -> Column:
    """E-mail, card, SSN, spoken digit run, phone, in this order."""
    t = F.when(col(text).contains("@"), F.regexp_replace(col(text), EMAIL, TAGS["email"])).otherwise(col(text))
    t = replace_where(t, CARD, is_card, TAGS["card"])
    t = F.regexp_replace(t, SSN, TAGS["ssn"])
    t = F.regexp_replace(t, SPOKEN, TAGS["spoken"])
    return replace_where(t, PHONE, lambda h: is_phone(h, strict_phone), TAGS["phone"])


def with_redacted(df: DataFrame, column: str, target: str | None = None, strict_phone: bool = False) -> DataFrame:
    return df.withColumn(target or column, redact(column, strict_phone))


def tag_counts(redacted: str | Column) -> list[Column]:
    """Number of replacements per kind in an already redacted text."""
    t = col(redacted)
    return [F.regexp_count(t, F.lit(tag.replace("[", r"\[").replace("]", r"\]"))).cast("bigint").alias(kind) for kind, tag in TAGS.items()]


def pii_counts(text: str | Column) -> list[Column]:
    """Occurrences per kind still present in a text (phone and card only when their predicate holds)."""
    t = col(text)
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("bigint")
    matched = lambda p, ok: F.when(t.rlike(p), F.size(F.filter(F.regexp_extract_all(t, F.lit(f"({p})"), F.lit(1)), ok))).otherwise(0).cast("bigint")
    return [
        count(EMAIL).alias("email"), matched(CARD, is_card).alias("card"), count(SSN).alias("ssn"),
        count(SPOKEN).alias("spoken"), matched(PHONE, lambda h: is_phone(h)).alias("phone"),
    ]


def redact_value(value: Column, dtype: T.DataType) -> Column:
    """Redacts every string inside a nested value; keys, numbers and types stay as they are."""
    if isinstance(dtype, T.StringType):
        return redact(value)
    if isinstance(dtype, T.ArrayType) and _has_text(dtype.elementType):
        return F.transform(value, lambda x: redact_value(x, dtype.elementType))
    if isinstance(dtype, T.MapType) and _has_text(dtype.valueType):
        return F.transform_values(value, lambda _, v: redact_value(v, dtype.valueType))
    if isinstance(dtype, T.StructType) and _has_text(dtype):
        fields = [redact_value(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _has_text(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_text(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _has_text(dtype.valueType)
    return isinstance(dtype, T.StringType)


def redact_deep(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: redact_value(F.col(c), df.schema[c].dataType) for c in (columns or df.columns)})


def audit(df: DataFrame, text: str, by: list[str]) -> DataFrame:
    """Rows and occurrences per kind: what a table still contains."""
    counted = df.select(*by, *pii_counts(text))
    return counted.groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[F.sum(k).alias(f"{k}_n") for k in KINDS], *[F.count_if(F.col(k) > 0).alias(f"{k}_rows") for k in KINDS]
    )
