"""Names usable from SQL: SQL functions that the optimizer inlines, Arrow functions and the section splitter as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import redaction as R
from callgrain.functions import spoken
from callgrain.sources import recogniser


@F.udtf(returnType="heading string, body string")
class TextSections:
    """Sections of a text headed by '## Heading' lines."""

    def eval(self, text: str):
        heading, body = None, []
        for line in (text or "").splitlines():
            if line.startswith("## "):
                if heading is not None:
                    yield heading, "\n".join(body).strip()
                heading, body = line[3:].strip(), []
            else:
                body.append(line)
        if heading is not None:
            yield heading, "\n".join(body).strip()


def _map(values: dict) -> str:
    return "map(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"


def _swapped(pattern: str, keep: str, tag: str) -> str:
    """Matches ``h`` for which ``keep`` holds become the tag; texts without a match skip that work."""
    hits = f"transform(regexp_extract_all(t, r'({pattern})', 1), h -> CASE WHEN {keep} THEN '{tag}' ELSE h END)"
    return f"CASE WHEN t RLIKE r'{pattern}' THEN array_join(zip_with(split(t, r'{pattern}', -1), {hits}, (g, h) -> concat(g, coalesce(h, ''))), '') ELSE t END"


_DIGITS = r"regexp_replace(h, r'\D', '')"
_GROUPS = r"filter(split(h, r'\D+'), g -> g <> '')"
_IS_CARD = f"length({_DIGITS}) BETWEEN 13 AND 19 AND (luhn_check({_DIGITS}) OR trim(h) RLIKE r'{R.CARD_GROUPS}')"
_IS_PHONE = rf"""length({_DIGITS}) >= 10 AND NOT h RLIKE r'[.,;][{R.BLANK}]' AND (size({_GROUPS}) = 1 OR forall({_GROUPS}, g -> length(g) <= 4)
 OR regexp_replace(h, r'^[{R.BLANK}]+', '') RLIKE r'^[+(]' OR (size({_GROUPS}) = 2 AND length(try_element_at({_GROUPS}, 1)) <= 4))"""
_WORDS = f"split(h, r'{spoken.ORDINAL_BREAKS}')"
_VALUE = f"try_element_at({_map(V.ORDINAL_WORDS)}, element_at({_WORDS}, -1))"
_STOP = ", ".join(f"'{w}'" for w in (*V.ORDINAL_SUFFIXES, *V.VALUE_STOP_WORDS))

#: (signature, body) in the order in which they use each other. The rules are those of the Column builders.
SQL_FUNCTIONS = [
    ("redact_emails(t STRING) RETURNS STRING", f"CASE WHEN contains(t, '@') THEN regexp_replace(t, r'{R.EMAIL}', '{R.TAGS['email']}') ELSE t END"),
    ("redact_cards(t STRING) RETURNS STRING", _swapped(R.CARD, _IS_CARD, R.TAGS["card"])),
    ("redact_spelled(t STRING) RETURNS STRING", f"regexp_replace(regexp_replace(t, r'{R.SSN}', '{R.TAGS['ssn']}'), r'{R.SPOKEN}', '{R.TAGS['spoken']}')"),
    ("redact_phones(t STRING) RETURNS STRING", _swapped(R.PHONE, _IS_PHONE, R.TAGS["phone"])),
    ("redact(t STRING) RETURNS STRING", "redact_phones(redact_spelled(redact_cards(redact_emails(t))))"),
    ("written_numbers(t STRING) RETURNS ARRAY<STRING>", f"transform(regexp_extract_all(t, r'{spoken.WRITTEN}', 1), x -> regexp_replace(x, ',', ''))"),
    ("ordinal_numbers(t STRING) RETURNS ARRAY<STRING>", f"""transform(regexp_extract_all(lower(t), r'{spoken.ORDINALS}', 0),
 h -> CAST({_VALUE} + CASE WHEN {_VALUE} < 10 THEN coalesce(try_element_at({_map(V.ORDINAL_TENS)}, {_WORDS}[0]), 0) ELSE 0 END AS STRING))"""),
    ("all_numbers(t STRING, spoken ARRAY<STRING>) RETURNS ARRAY<STRING>", "array_distinct(concat(written_numbers(t), spoken, ordinal_numbers(t)))"),
    ("plain_text(t STRING) RETURNS STRING", r"trim(regexp_replace(lower(t), r' *[^a-z0-9$. -][^a-z0-9$.-]*| {2,}', ' '))"),
    ("compact_text(t STRING) RETURNS STRING", f"regexp_replace(lower(t), r'{spoken.COMPACT}', '')"),
    ("grounded(v STRING, core STRING, parts ARRAY<STRING>, spelled ARRAY<STRING>, t STRING, numbers ARRAY<STRING>) RETURNS BOOLEAN", rf"""coalesce(CASE WHEN v = '' THEN false
 WHEN v RLIKE r'\d' THEN core <> '' AND forall(filter(regexp_extract_all(lower(v), r'{spoken.VALUE_NAMES}', 1), w -> w NOT IN ({_STOP})), w -> contains(lower(t), w)) AND (array_contains(numbers, core)
  OR (size(parts) > 1 AND regexp_like(t, array_join(transform(parts, x -> concat(r'{spoken.NOT_AFTER_DIGIT}', x, r'{spoken.NOT_BEFORE_DIGIT}')), r'{spoken.PART_GAP}'))) OR (v RLIKE '[a-zA-Z]' AND contains(compact_text(t), compact_text(v))))
 ELSE (size(spelled) > 0 AND forall(spelled, n -> array_contains(numbers, n)))
  OR (size(filter(split(plain_text(v), ' '), w -> length(w) > 2)) > 0 AND forall(filter(split(plain_text(v), ' '), w -> length(w) > 2), w -> contains(concat(' ', plain_text(t), ' '), w))) END, false)"""),
    ("is_said(v STRING, value_spoken ARRAY<STRING>, t STRING, text_spoken ARRAY<STRING>) RETURNS BOOLEAN",
     f"grounded(trim(v), regexp_replace(regexp_replace(trim(v), r'{spoken.VALUE_CORE}', ''), r'{spoken.VALUE_CORE_EDGES}', ''), regexp_extract_all(trim(v), r'{spoken.VALUE_PARTS}', 1), concat(value_spoken, ordinal_numbers(v)), t, all_numbers(t, text_spoken))"),
    ("nearest_rank(items ARRAY<DOUBLE>, p DOUBLE) RETURNS DOUBLE", "try_element_at(array_sort(items), least(size(items) - 1, CAST(floor(size(items) * p) AS INT)) + 1)"),
    ("number_set(t STRING) RETURNS ARRAY<STRING>", "all_numbers(t, number_tokens(t))"),
    ("value_in_text(v STRING, t STRING) RETURNS BOOLEAN", "is_said(v, number_tokens(v), t, number_tokens(t))"),
]


def register(spark: SparkSession) -> None:
    """Registers all names for the session. ``nearest_rank`` takes a list of a bounded group: nearest_rank(collect_list(x), 0.9)."""
    spark.udf.register("wer_tokens", spoken.wer_tokens)
    spark.udf.register("number_tokens", spoken.number_tokens)
    spark.udf.register("wer_counts", spoken.edit_counts)
    spark.udf.register("reattach_punctuation", recogniser.reattach_punctuation)
    spark.udtf.register("text_sections", TextSections)
    for signature, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
