"""Spoken and written numbers, transcript tokens and word error rate.

The number-word reader is a small state machine and runs in Arrow batches;
everything around it is Column expressions.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callgrain import vocab as V
from callgrain.functions.columns import col, in_set, let, lookup

MARK = "|"  # sentence end inside a token list
_SKIP = frozenset(V.FILLERS) | frozenset(V.CURRENCY_WORDS)

# --- fixed values: patterns of the reader, the strict tokens, the number sets and of value matching
_GROUPED = re.compile(r"(\d),(\d)", re.ASCII)
_SENTENCE = re.compile(r"[.?!;](\s|\ufeff|\Z)")
_OTHER = re.compile(r"[^a-z0-9' |]")
_ASCII_DIGITS = frozenset("0123456789")
_NUMBER_WORDS = frozenset(V.UNIT_WORDS) | frozenset(V.TEN_WORDS) | {"hundred"}
STRICT_GROUPED = r"(\d),(?=\d)"
STRICT_OTHER = r"[^a-z0-9'.$ -]"
STRICT_MARKS = r"(^|\s)[.$]+(?=\s|$)"
STRICT_EDGES = r"^[.']+|[.']+$"
#: An ordinal with the word of ten before it, if any. Words are runs of a-z; those of ten are no ordinals, so matches never overlap.
ORDINALS = rf"(?<![a-z])(?=[{''.join(sorted({w[0] for w in (*V.ORDINAL_WORDS, *V.ORDINAL_TENS)}))}])(?:(?:{'|'.join(V.ORDINAL_TENS)})[^a-z]+)?(?:{'|'.join(V.ORDINAL_WORDS)})(?![a-z])"
ORDINAL_BREAKS = "[^a-z]+"
WRITTEN = r"(\d[\d,]*(?:\.\d+)?)"
VALUE_NAMES = r"([a-z]{3,})"
VALUE_CORE, VALUE_CORE_EDGES = r"[^\d.]", r"^\.+|\.+$"
VALUE_PARTS, NOT_AFTER_DIGIT, NOT_BEFORE_DIGIT, PART_GAP = r"(\d+)", r"(?<!\d)", r"(?!\d)", r"\D{1,4}"
COMPACT = "[^a-z0-9]"
#: A run with any other character, or of several blanks; single blanks are not touched. The letters are listed, not given as
#: ranges: Java looks listed ones up in a table, tasks of one process that test ranges hold each other up.
_KEPT = "abcdefghijklmnopqrstuvwxyz0123456789$."
PLAIN_OTHER = rf" *[^{_KEPT} -][^{_KEPT}-]*| {{2,}}"


# ------------------------------------------------------------- token machine


def _is_number_word(w: str | None) -> bool:
    return w in _NUMBER_WORDS


def read_numbers(tokens: list[str]) -> list[str]:
    """Number words to digits. An open number closes where the next word cannot belong to it:
    a ten or teen not directly after "hundred", or a second single digit."""
    out: list[str] = []
    value, last = None, ""
    for i, w in enumerate(tokens):
        number = w in _NUMBER_WORDS
        if not number and value is None:
            out.append(V.WRITTEN_ORDINALS.get(w, w))
            continue
        if w == "oh" and value is None:
            around = (tokens[i - 1] if i else None, tokens[i + 1] if i + 1 < len(tokens) else None)
            number = any(map(_is_number_word, around))
        if not number:
            if value is not None:
                out.append(str(value))
                value = None
            out.append(V.WRITTEN_ORDINALS.get(w, w))
            continue
        unit = V.UNIT_WORDS.get(w)
        if value is not None:
            completes_ten = last in V.TEN_WORDS and unit is not None and 1 <= unit <= 9
            opens_new = (w in V.TEN_WORDS or (unit is not None and unit >= 10)) and last != "hundred"
            second_digit = unit is not None and unit < 10 and value < 10
            if not completes_ten and (opens_new or second_digit):
                out.append(str(value))
                value = None
        base = value or 0
        value = (base or 1) * 100 if w == "hundred" else base + (unit if unit is not None else V.TEN_WORDS[w])
        last = w
    if value is not None:
        out.append(str(value))
    return out


def spoken_tokens(text: str) -> list[str]:
    """Comparable tokens of a transcript: numbers as digits, digit-by-digit numbers joined within a sentence."""
    t = _SENTENCE.sub(f" {MARK} ", _GROUPED.sub(r"\1\2", text.lower()))
    words = [w for w in _OTHER.sub(" ", t.replace("-", " ")).split() if w not in _SKIP]
    nums = read_numbers(words)
    out: list[str] = []
    for i, w in enumerate(nums):
        if w == "and" and 0 < i < len(nums) - 1 and nums[i - 1][0] in _ASCII_DIGITS and nums[i + 1][0] in _ASCII_DIGITS:
            continue
        if w in _ASCII_DIGITS and out and out[-1].isdigit() and len(out[-1]) < 9:
            out[-1] += w
        else:
            out.append(w)
    return [w for w in out if w != MARK]


@F.pandas_udf(T.ArrayType(T.StringType()))
def wer_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else spoken_tokens(t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def number_tokens(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else [w for w in spoken_tokens(t) if w.isascii() and w.isdigit()])


def strict_tokens(text: str | Column) -> Column:
    """Tokens with only case, punctuation and fillers removed."""
    t = F.regexp_replace(F.lower(col(text)), STRICT_GROUPED, "$1")
    t = F.regexp_replace(F.regexp_replace(t, STRICT_OTHER, " "), "-", " ")
    t = F.regexp_replace(t, STRICT_MARKS, " ")
    bare = F.transform(F.split(t, r"\s+"), lambda w: F.regexp_replace(w, STRICT_EDGES, ""))
    return F.filter(bare, lambda w: (w != "") & ~in_set(w, V.FILLERS))


# -------------------------------------------------------------- edit distance

EDITS = T.StructType([
    T.StructField("distance", T.IntegerType()), T.StructField("ref_words", T.IntegerType()),
    T.StructField("substitutions", T.IntegerType()), T.StructField("deletions", T.IntegerType()), T.StructField("insertions", T.IntegerType()),
])


def token_edits(ref, hyp) -> tuple[int, int, int, int, int]:
    """Edit distance and its parts, one DP row at a time (memory grows with one text, not the product).

    The traced path prefers diagonal, then deletion, then insertion. Along any
    path deletions - insertions and the total are known, so only substitutions
    have to be carried next to the distances.
    """
    n_ref, n, m = len(ref), len(ref), len(hyp)
    while n and m and ref[n - 1] == hyp[m - 1]:  # a matching tail is always traced diagonally
        n, m = n - 1, m - 1
    ids: dict[str, int] = {}
    r = np.array([ids.setdefault(w, len(ids)) for w in ref[:n]], dtype=np.int64)
    h = np.array([ids.setdefault(w, len(ids)) for w in hyp[:m]], dtype=np.int64)
    steps = np.arange(m + 1)
    dist, subs = steps.copy(), np.zeros(m + 1, dtype=np.int64)
    for i in range(1, n + 1):
        differs = (h != r[i - 1]).astype(np.int64)
        diag, up = dist[:-1] + differs, dist[1:] + 1
        best = np.empty(m + 1, dtype=np.int64)
        best[0] = i
        best[1:] = np.minimum(diag, up)
        new = np.minimum.accumulate(best - steps) + steps
        from_diag, from_up = new[1:] == diag, new[1:] == up
        carried = np.empty(m + 1, dtype=np.int64)
        carried[0] = subs[0]
        carried[1:] = np.where(from_diag, subs[:-1] + differs, subs[1:])
        anchored = np.concatenate(([True], from_diag | from_up))
        subs = carried[np.maximum.accumulate(np.where(anchored, steps, 0))]
        dist = new
    total, s = int(dist[m]), int(subs[m])
    deletions = (total - s + (n - m)) // 2
    return total, n_ref, s, deletions, total - s - deletions


@F.pandas_udf(EDITS)
def edit_counts(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    rows = [token_edits(list(a), list(b)) for a, b in zip(ref, hyp)]
    return pd.DataFrame(rows, columns=[f.name for f in EDITS.fields])


def word_error_rate(edits: Column, hyp_tokens: Column) -> Column:
    """Distance over reference words; an empty reference scores 1 when anything was heard."""
    empty = F.when(F.size(hyp_tokens) > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(edits["ref_words"] == 0, empty).otherwise(edits["distance"] / edits["ref_words"])


# ---------------------------------------------------------------- number sets


def ordinal_numbers(text: str | Column) -> Column:
    """Spoken ordinals as numbers: "fourteenth" -> 14, "twenty-first" -> 21. One search finds them, only they are read."""
    hits = F.regexp_extract_all(F.lower(col(text)), F.lit(ORDINALS), F.lit(0))
    words = F.transform(hits, lambda h: F.split(h, ORDINAL_BREAKS))
    value = lambda ws: lookup(V.ORDINAL_WORDS, F.element_at(ws, -1))
    tens = lambda ws: lookup(V.ORDINAL_TENS, ws[0], 0)
    return F.transform(words, lambda ws: (value(ws) + F.when(value(ws) < 10, tens(ws)).otherwise(F.lit(0))).cast("string"))


def written_numbers(text: str | Column) -> Column:
    found = F.regexp_extract_all(col(text), F.lit(WRITTEN), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, ",", ""))


def number_set(text: str | Column) -> Column:
    """Every number of a text as digits: written, spoken, and spoken as an ordinal."""
    t = col(text)
    return F.array_distinct(F.concat(written_numbers(t), number_tokens(t), ordinal_numbers(t)))


def grounded(value: Column, value_numbers: Column, text: Column, text_numbers: Column) -> Column:
    """Does the value occur in the text?

    ``value_numbers`` are the spoken and ordinal numbers of the value,
    ``text_numbers`` the number set of the text; both are computed once per row.
    """
    v = F.trim(value)
    stop = [*V.ORDINAL_SUFFIXES, *V.VALUE_STOP_WORDS]
    named = F.filter(F.regexp_extract_all(F.lower(v), F.lit(VALUE_NAMES), F.lit(1)), lambda w: ~w.isin(*stop))
    names_said = let(F.lower(text), lambda low: F.forall(named, lambda w: low.contains(w)))
    core = F.regexp_replace(F.regexp_replace(v, VALUE_CORE, ""), VALUE_CORE_EDGES, "")
    parts = F.regexp_extract_all(v, F.lit(VALUE_PARTS), F.lit(1))
    side_by_side = F.array_join(F.transform(parts, lambda x: F.concat(F.lit(NOT_AFTER_DIGIT), x, F.lit(NOT_BEFORE_DIGIT))), PART_GAP)
    compact = lambda x: F.regexp_replace(F.lower(x), COMPACT, "")
    numeric = names_said & (core != "") & (
        F.array_contains(text_numbers, core)
        | ((F.size(parts) > 1) & F.regexp_like(text, side_by_side))
        | (v.rlike("[a-zA-Z]") & compact(text).contains(compact(v)))
    )
    spelled = (F.size(value_numbers) > 0) & F.forall(value_numbers, lambda n: F.array_contains(text_numbers, n))
    words = F.filter(F.split(plain(v), " "), lambda w: F.length(w) > 2)
    padded = F.concat(F.lit(" "), plain(text), F.lit(" "))
    worded = (F.size(words) > 0) & let(padded, lambda hay: F.forall(words, lambda w: hay.contains(w)))
    return F.coalesce(F.when(v == "", F.lit(False)).when(v.rlike(r"\d"), numeric).otherwise(spelled | worded), F.lit(False))


def plain(text: str | Column) -> Column:
    """Lower case, letters, digits and $ . - kept, single spaces."""
    return F.trim(F.regexp_replace(F.lower(col(text)), PLAIN_OTHER, " "))


# ----------------------------------------------------- corrections, ambiguity

_ORDINAL_HINT = "|".join(V.ORDINAL_WORDS)


def spoken_corrections(text: str | Column) -> Column:
    """Array of (original, corrected): two numbers at most five words apart with a correction word between."""
    cut = F.split(F.regexp_replace(col(text), r"\.(?=\s|$)", " "), r"\s+")
    cleaned = F.filter(F.transform(cut, lambda w: F.regexp_replace(w, r"^[^\w$]+|[^\w]+$", "")), lambda w: w != "")
    int_len = lambda v: F.length(F.substring_index(v, ".", 1))

    def number(w: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(w, r"^\$", ""), ",", "")
        return F.when(bare.rlike(r"^\d+(\.\d+)?$"), bare).when(
            F.lower(w).rlike(_ORDINAL_HINT), F.try_element_at(ordinal_numbers(w), F.lit(1))
        )

    def found(words: Column) -> Column:
        numbers = F.filter(
            F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("raw"), number(w).alias("v"))), lambda x: x["v"].isNotNull()
        )

        def judged(pair: Column) -> Column:
            a, b = pair["a"], pair["b"]
            between = F.slice(words, a["i"] + 2, F.greatest(F.lit(0), b["i"] - a["i"] - 1))
            return (
                (b["i"] - a["i"] - 1 <= 5) & (a["v"] != b["v"]) & (F.abs(int_len(a["v"]) - int_len(b["v"])) <= 1)
                & F.exists(between, lambda w: F.lower(w).isin(*V.CORRECTION_MARKERS))
            )

        def paired(ix: Column) -> Column:
            rest = F.slice(ix, 2, F.greatest(F.size(ix), F.lit(1)))
            pairs = F.filter(F.zip_with(ix, rest, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["b"].isNotNull())
            return F.transform(F.filter(pairs, judged), lambda p: F.struct(p["a"]["raw"].alias("original"), p["b"]["raw"].alias("corrected")))

        return let(numbers, paired)

    return let(cleaned, found)


def has_bare_amount(amount: Column, text: Column) -> Column:
    """A four-digit amount that occurs without a currency sign before or a currency word after it."""
    near_word = r"(?!\s{0,3}dollar|\s{0,6}usd|\s{0,4}bucks)"
    pattern = F.concat(F.lit(r"(?i)(?:^|(?<!\$)[^\d$.,])"), amount, F.lit(rf"(?![\d.,]?\d){near_word}"))
    return F.regexp_like(text, pattern)


def ambiguous_amounts(amounts: Column, text: str | Column) -> Column:
    """Notes on amounts that may be dollars and cents: "36 70", or a bare "2299"."""
    t = col(text)
    pair = r"^(\d{1,3})[ ,](\d{2})$"

    def note(raw: Column) -> Column:
        v = F.trim(raw)
        a, b = F.regexp_extract(v, pair, 1), F.regexp_extract(v, pair, 2)
        head, tail = F.substring(v, 1, 2), F.substring(v, 3, 4)
        # fixed values: wording of the two notes
        two = F.concat(F.lit('Heard "'), v, F.lit('" as an amount written as two numbers; it may be $'), a, F.lit("."), b, F.lit(" and should be confirmed."))
        bare = F.concat(
            F.lit('Heard "'), v, F.lit('" as an amount without a currency or decimal point; it may be $'), head, F.lit("."), tail,
            F.lit(' (spoken as "'), head, F.lit(", "), tail, F.lit('") and should be confirmed.'),
        )
        return F.when(v.rlike(pair), two).when(v.rlike(r"^\d{4}$") & has_bare_amount(v, t), bare)

    return F.array_compact(F.transform(amounts, note))
