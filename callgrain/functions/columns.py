"""Small Column builders used everywhere."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an expression once. Inside a lambda a plain expression would be evaluated per element."""
    return F.transform(F.array(value), body)[0]


def half_up(value: str | Column, digits: int = 0) -> Column:
    """Round half towards plus infinity (Spark's round goes away from zero)."""
    scale = float(10**digits)
    return F.floor(col(value) * scale + 0.5).cast("double") / scale


def lookup(mapping: Mapping, key: str | Column, default=None) -> Column:
    """Constant map lookup; None keys of the map are not supported."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def rank_in(values: Sequence[str], value: str | Column) -> Column:
    """0-based position in a fixed order, length of the list when absent."""
    return lookup({v: i for i, v in enumerate(values)}, value, len(values))


def in_set(value: str | Column, values: Sequence) -> Column:
    return col(value).isin(*values)


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null (not zero) when den is zero."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch for TIMESTAMP or TIMESTAMP_NTZ, read as UTC."""
    return F.unix_micros(col(ts).cast("timestamp"))


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(1e6)


def semitones(hz: str | Column) -> Column:
    """Pitch relative to 100 Hz."""
    return F.lit(12.0) * F.log2(col(hz) / 100.0)


def semitones_to_hz(st: str | Column) -> Column:
    return half_up(F.lit(100.0) * F.pow(F.lit(2.0), col(st) / 12.0))


def decibels(power: str | Column) -> Column:
    return F.lit(10.0) * F.log10(col(power) + 1e-12)


def clamp(value: str | Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(value)))


def sorted_values(value: str | Column) -> Column:
    """Aggregate: the values in order; sort_array is compiled, array_sort calls an interpreted comparison for each pair."""
    return F.sort_array(F.collect_list(col(value)))


def rank_of(items: str | Column, p: float) -> Column:
    """Element floor(n*p) of an array of sorted values."""
    n = F.size(col(items))
    at = F.least(n - 1, F.floor(n * F.lit(p)).cast("int")) + 1
    return F.when(n > 0, F.try_element_at(col(items), at))


def nearest_rank(value: str | Column, p: float) -> Column:
    """Aggregate: element floor(n*p) of the sorted values.

    For groups of bounded size (a phrase, a file). For groups that grow with
    the data use ``operators.quantiles.nearest_rank_by``.
    """
    return rank_of(sorted_values(value), p)


def upper_median(value: str | Column) -> Column:
    return nearest_rank(value, 0.5)


def fmt_count(ok: str | Column, total: str | Column) -> Column:
    """'x/y (p%)', or 'n/a' when nothing was counted."""
    ok, total = col(ok), col(total)
    pct = half_up(ratio(ok, total) * 100).cast("bigint")
    text = F.concat(ok.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), pct.cast("string"), F.lit("%)"))
    return F.when(total > 0, text).otherwise(F.lit("n/a"))
