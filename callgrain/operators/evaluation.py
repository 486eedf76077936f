"""Scoring predictions against labelled truth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions.columns import col, fmt_count, half_up, ratio
from callgrain.operators.intervals import WORD, outside_script
from callgrain.operators.sequence import neighbours


def background_scores(words: DataFrame, truth: DataFrame) -> DataFrame:
    """Per call: environment words flagged (tp), missed (fn), scripted words wrongly flagged (fp)."""
    outside = outside_script(words, truth).select(*WORD, F.lit(True).alias("__out"))
    rows = words.select(*WORD, "background").join(outside, WORD, "left").withColumn("__out", F.coalesce("__out", F.lit(False)))
    return rows.groupBy("call_id").agg(
        F.count_if(F.col("__out") & F.col("background")).alias("tp"), F.count_if(F.col("__out") & ~F.col("background")).alias("fn"),
        F.count_if(~F.col("__out") & F.col("background")).alias("fp"),
    )


def truth_events(lines: DataFrame, *, key: str = "call_id", order: str = "turn", chunk: str = "chunk") -> DataFrame:
    """Scripted overlaps and cut-offs. ``lines``: (key, order, chunk, who, text, start_ms, end_ms)."""
    near = neighbours(
        lines, key=[key], chunk=chunk, order=[order],
        previous={"prev_who": "who", "prev_end_ms": "end_ms"}, following={"next_who": "who", "next_start_ms": "start_ms"},
    )
    overlaps = ~F.col("is_first") & (F.col("who") != F.col("prev_who")) & (F.col("start_ms") < F.col("prev_end_ms") - 50)
    cut_off = ~F.col("is_last") & F.trim("text").rlike("[—-]$") & (F.col("next_who") != F.col("who"))
    event = lambda when, at, kind: F.when(when, F.struct(at.alias("at"), F.lit(kind).alias("kind")))
    both = F.array_compact(F.array(event(overlaps, F.col("start_ms"), "simultaneous"), event(cut_off, F.col("next_start_ms"), "interruption")))
    return near.select(key, order, F.inline(both))


def _cells(rows: DataFrame, checks: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """(name, ok, note) of each counted check of each row."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("name"), ok.alias("ok"), (F.lit(None).cast("string") if note is None else note).alias("note"))
        for n, (ok, note) in checks.items()
    ])
    return rows.select(F.inline(cells)).where("ok IS NOT NULL")


def score_matrix(rows: DataFrame, checks: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """ok / total / percent per named check; a null check is not counted.

    ``checks`` maps a name to (condition, note); the notes of failures are a
    table of their own, see ``failure_notes``.
    """
    tally = _cells(rows, checks).groupBy("name").agg(F.count_if("ok").alias("ok"), F.count("*").alias("total"))
    return tally.select("name", "ok", "total", half_up(ratio("ok", "total") * 100).cast("bigint").alias("pct"))


def failure_notes(rows: DataFrame, checks: Mapping[str, tuple[Column, Column | None]]) -> DataFrame:
    """(name, note): every different note of a failed check, one row each."""
    return _cells(rows, checks).where("NOT ok AND note IS NOT NULL").select("name", "note").distinct()


def matrix_rows(scores: DataFrame, category: str | Column, source: str) -> DataFrame:
    """Score rows in the shape of the accuracy matrix; ``source`` is 'live' or 'offline'."""
    cell = fmt_count("ok", "total")
    other = F.lit("n/a")
    return scores.select(
        (F.lit(category) if isinstance(category, str) else category).alias("category"), F.col("name").alias("measure"),
        (cell if source == "live" else other).alias("live"), (cell if source == "offline" else other).alias("offline"),
        F.when(F.col("ok") == F.col("total"), F.lit("none")).otherwise(F.concat((F.col("total") - F.col("ok")).cast("string"), F.lit(" failed"))).alias("failures"),
    )


def assemble_matrix(live: DataFrame, offline: DataFrame) -> DataFrame:
    """One row per measure with its live and offline cells."""
    both = live.unionByName(offline)
    best = lambda c: F.coalesce(F.max(F.when(F.col(c) != "n/a", F.col(c))), F.lit("n/a"))
    failures = F.coalesce(F.max(F.when(F.col("failures") != "none", F.col("failures"))), F.lit("none"))
    return both.groupBy("category", "measure").agg(best("live").alias("live"), best("offline").alias("offline"), failures.alias("failures"))


def flag_scores(predicted: DataFrame, truth: DataFrame, flags: Sequence[str], key: str = "id") -> DataFrame:
    """Right / checked per flag; only flags the truth states (not null) are checked."""
    long = lambda df, name: df.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias(name)) for f in flags])))
    joined = long(truth, "expected").where("expected IS NOT NULL").join(long(predicted, "got"), [key, "flag"])
    return joined.groupBy("flag").agg(F.count_if(F.col("expected") == F.col("got")).alias("right_n"), F.count("*").alias("checks"))


def stray_values(heard: Column, wanted: Column, allowed: Column) -> Column:
    """Heard numbers of two or more digits that are neither wanted, allowed, nor part of a wanted one."""
    numeric = lambda x: x.rlike(r"^\d{2,}$")
    related = lambda x: F.exists(wanted, lambda w: w.contains(x) | x.contains(w))
    return F.filter(heard, lambda x: numeric(x) & ~F.array_contains(allowed, x) & ~related(x))


def missing_values(heard: Column, wanted: Column) -> Column:
    return F.array_except(wanted, heard)


def strip_zeros(values: Column) -> Column:
    return F.transform(values, lambda v: F.regexp_replace(v, "^0+", ""))


def correction_hit(found: Column, original: str | Column, corrected: str | Column) -> Column:
    """A found correction whose digits contain, or are contained in, the scripted ones on both sides."""
    near = lambda a, b: a.contains(b) | b.contains(a)
    return F.exists(found, lambda k: near(k["original"], col(original)) & near(k["corrected"], col(corrected)))


def finding_checks(found_ids: Column, expected: Column, forbidden: Column) -> Column:
    """Struct of per-call counts: expected findings present, forbidden findings absent."""
    hits = F.size(F.array_intersect(F.array_distinct(expected), found_ids))
    alarms = F.size(F.array_intersect(F.array_distinct(forbidden), found_ids))
    n_exp, n_forb = F.size(F.array_distinct(expected)), F.size(F.array_distinct(forbidden))
    return F.struct(hits.alias("present"), n_exp.alias("expected"), (n_forb - alarms).alias("quiet"), n_forb.alias("forbidden"))
