"""Rule-made postmortem texts and their sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.functions.columns import col

# fixed values: section headings of a postmortem
HEADINGS = {"cause": "Cause", "chain": "Chain of events", "factors": "Contributing factors", "recommendation": "Recommendation"}


def postmortems(calls: DataFrame, stages: DataFrame, order: Sequence[str]) -> DataFrame:
    """One four-section text per call. A call has a handful of stage rows, which become its numbered chain."""
    line = F.format_string("%s (%s, %sms)", F.col("stage"), F.col("status"), F.col("duration_ms").cast("string"))
    steps = stages.groupBy(F.col("call_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")))).alias("steps")
    )
    numbered = F.array_join(
        F.transform("steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s["line"])), "\n"
    )
    failover = F.when(F.col("stt_failover_occurred"), F.lit(" after failover from primary")).otherwise(F.lit(""))
    body = {
        "cause": F.concat(F.lit("Classified as "), F.col("predicted_category"), F.lit(".")),
        "chain": F.coalesce(numbered, F.lit("")),
        "factors": F.concat(F.lit("STT served by "), F.coalesce("stt_provider_used", F.lit("unknown")), failover, F.lit(".")),
        "recommendation": F.concat(F.lit("Investigate the "), F.col("predicted_category"), F.lit(" failures as a group before single calls.")),
    }
    parts = [F.concat(F.lit(f"## {HEADINGS[k]}\n"), v) for k, v in body.items()]
    return calls.join(steps, "id", "left").select("id", F.concat_ws("\n\n", *parts).alias("report_text"))


def section(text: str | Column, heading: str) -> Column:
    """Body of the section whose heading starts with ``heading``, null when absent."""
    found = F.regexp_extract(col(text), rf"(?ims)^##\s+{heading}[^\n]*\n?(.*?)(?=^##\s|\z)", 1)
    present = col(text).rlike(rf"(?im)^##\s+{heading}")
    return F.when(present, F.regexp_replace(found, r"^\s+|\s+$", ""))


def sections(reports: DataFrame, text: str = "report_text") -> DataFrame:
    # fixed values: heading prefixes read back
    prefixes = {"cause": "cause", "chain": "chain", "factors": "contributing", "recommendation": "recommend"}
    return reports.select("*", *[section(text, p).alias(name) for name, p in prefixes.items()])
