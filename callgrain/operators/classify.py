"""Outcome of a call from its stages and signals: the first rule that holds wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import predicates as P
from callgrain.functions.columns import lookup, rank_in


def breaching_stages(stages: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First main stage per call that timed out or ran past its limit.

    ``order`` names extra columns that order rows of the same stage.
    """
    limit = lookup(V.STAGE_LIMIT_MS, "stage")
    main = stages.where(P.in_set("stage", V.MAIN_STAGES)).withColumn("limit_ms", limit)
    slow = main.where((F.col("status") == "timeout") | (F.col("duration_ms") > F.col("limit_ms")))
    position = F.struct(rank_in(V.MAIN_STAGES, "stage").alias("r"), *[F.col(c) for c in order or []])
    return slow.groupBy("call_id").agg(F.min_by(F.struct("stage", "duration_ms", "limit_ms"), position).alias("slow"))


def classify(calls: DataFrame, stages: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(id, category, confidence, reason).

    ``calls`` carries the signals network_dropped, hung_up, exception_type,
    hallucinated, transcript_empty, stt_confidence, stt_provider_used and
    reply_mismatch.
    """
    slow = breaching_stages(stages, order).withColumnRenamed("call_id", "id")
    threshold = P.confidence_threshold("stt_provider_used")
    heard = F.coalesce("stt_confidence", F.lit(0.0))
    off = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = lambda c, n, why: F.struct(F.lit(c).alias("category"), F.lit(n).alias("confidence"), why.alias("reason"))
    # fixed values: confidence and wording per rule
    rules = (
        F.when(off("network_dropped"), out("network_drop", 1.0, F.lit("websocket close event received")))
        .when(off("hung_up"), out("user_hangup", 1.0, F.lit("user cancellation signal received")))
        .when(F.coalesce("exception_type", F.lit("")) != "", out("exception", 0.95, F.concat(F.lit("unhandled "), F.col("exception_type"), F.lit(" caught"))))
        .when(F.col("slow").isNotNull(), out("timeout", 0.95, F.format_string(
            "stage %s exceeded SLA (%dms > %dms)", F.col("slow.stage"), F.col("slow.duration_ms"), F.col("slow.limit_ms"))))
        .when(off("hallucinated"), out("hallucination", 0.85, F.lit("grounding check flagged response")))
        .when(off("transcript_empty"), out("bad_stt", 0.85, F.lit("speech-to-text returned an empty transcript")))
        .when((heard > 0) & (heard < threshold), out("bad_stt", 0.9, F.concat(
            F.format_string("avg STT confidence %.2f < threshold ", heard), threshold.cast("string"))))
        .when(off("reply_mismatch"), out("tts_glitch", 0.8, F.lit("tts duration mismatch vs. expected")))
        .otherwise(out("ok", 0.9, F.lit("no failure signals")))
    )
    return calls.join(slow, "id", "left").select("id", rules.alias("c")).select("id", "c.*")


def call_status(category: str = "category"):
    return F.when(F.col(category) == "ok", "completed").otherwise("failed")
