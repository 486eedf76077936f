"""Listing, detail, cost and maintenance operators over calls and stages.

All functions answer for every tenant at once (grouped by ``owner_id``) unless
an owner is passed; ``as_of`` is an explicit timestamp column or literal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import predicates as P
from callgrain.functions.columns import col, lookup, rank_in, ratio, seconds_between


def hours(n: float) -> Column:
    return F.expr(f"INTERVAL {n} HOURS")


def newest_first(ts: str = "started_at", key: str = "id") -> list[Column]:
    return [F.col(ts).desc_nulls_last(), F.col(key).asc()]


def scope(df: DataFrame, owner, include_shared: bool = False) -> DataFrame:
    """Rows of one tenant; with ``include_shared`` also the ownerless rows."""
    mine = F.col("owner_id") == F.lit(owner)
    return df.where(mine | F.col("owner_id").isNull()) if include_shared else df.where(mine)


def list_calls(
    calls: DataFrame, owner, *, category=None, fault=None, source=None, provider=None, limit: int | None = 20
) -> DataFrame:
    df = scope(calls, owner)
    facets = {
        "predicted_category": category, "injected_fault": fault, "input_source": source, "stt_provider_used": provider,
    }
    for name, wanted in facets.items():
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    return df.orderBy(*newest_first()).limit(min(100, max(1, limit or 20)))


def with_labels_from_document(calls: DataFrame, document: str = "analysis") -> DataFrame:
    """Intent and difficulty read out of the stored analysis JSON."""
    return calls.withColumns({
        "intent": F.get_json_object(document, "$.understanding.primary_intent.label"),
        "difficulty": F.get_json_object(document, "$.difficulty.label"),
    })


def compact_document(document: str = "analysis") -> Column:
    """Only the parts of the analysis a comparison needs, as a new JSON object."""
    pick = lambda path: F.get_json_object(document, path)
    return F.to_json(F.struct(
        pick("$.script_match.wer").cast("double").alias("wer"),
        pick("$.speech.avg_confidence").cast("double").alias("avg_confidence"),
        pick("$.understanding.primary_intent.label").alias("intent"),
    ))


def latest_per_key(df: DataFrame, key: Sequence[str], ts: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Newest row of each key; partial aggregation keeps one row per key and task."""
    row = F.struct(*[F.col(c) for c in columns])
    return (
        df.groupBy(*key)
        .agg(F.max_by(row, F.struct(F.col(ts), F.col(tie))).alias("__row"))
        .select(*key, *[F.col("__row").getField(c).alias(c) for c in columns])
    )


def call_detail(calls: DataFrame, stages: DataFrame, reports: DataFrame) -> DataFrame:
    """Call, its stages in time order (one row per stage) and its newest report.

    Left long instead of nesting stages in an array, so a call with very many
    stage rows stays splittable.
    """
    newest = latest_per_key(reports, ["call_id"], "generated_at", "report_id", ["report_text", "generated_at"])
    with_report = calls.join(newest.withColumnRenamed("call_id", "id"), "id", "left")
    rows = stages.select(
        F.col("call_id").alias("id"), "stage", "provider", "duration_ms",
        F.col("status").alias("stage_status"), F.col("started_at").alias("stage_started_at"),
    )
    return with_report.join(rows, "id", "left")


def display_rows(calls: DataFrame, stages: DataFrame) -> DataFrame:
    """Cause, duration and cost as shown: cost falls back to the sum of stage costs."""
    spent = stages.groupBy(F.col("call_id").alias("id")).agg(F.sum(F.coalesce("cost_usd", F.lit(0.0))).alias("stage_cost"))
    return calls.join(spent, "id", "left").select(
        "id", "status", P.cause().alias("cause"),
        seconds_between("started_at", "ended_at").alias("duration_s"),
        F.coalesce(F.col("total_cost_usd"), F.col("stage_cost"), F.lit(0.0)).alias("cost_usd"),
        P.in_set("status", (*V.FINISHED, "aborted")).alias("is_finished"),
    )


def failing_stage(calls: DataFrame, stages: DataFrame) -> DataFrame:
    """First main stage that did not end ok, else the stage the cause points to."""
    bad = stages.where(P.in_set("stage", V.MAIN_STAGES) & (F.col("status") != "ok"))
    first = bad.groupBy(F.col("call_id").alias("id")).agg(F.min_by("stage", rank_in(V.MAIN_STAGES, "stage")).alias("broken"))
    caused = calls.withColumn("cause", P.cause()).where("cause IS NOT NULL")
    return caused.join(first, "id", "left").select(
        "id", "cause", F.coalesce(F.col("broken"), lookup(V.CAUSE_STAGE, "cause")).alias("failing_stage")
    )


# ---------------------------------------------------------------- maintenance


def upsert(base: DataFrame, delta: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows of ``delta`` replace rows of ``base`` with the same key; others are appended.

    Of rows of ``delta`` with the same key the last one by ``order`` counts (columns of ``delta``, dropped if ``base``
    lacks them); without an order, or in a tie, the greatest row does.
    """
    columns = [c for c in base.columns if c not in key]
    last = F.max(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("row")))
    newest = delta.groupBy(*key).agg(last.alias("__last")).select(*key, *[F.col("__last.row").getField(c).alias(c) for c in columns])
    return base.join(newest.select(*key), list(key), "left_anti").unionByName(newest)


def abort_in_flight(calls: DataFrame, ended_at: Column) -> DataFrame:
    return calls.withColumns({
        "ended_at": F.when(P.in_flight(), ended_at).otherwise(F.col("ended_at")),
        "status": F.when(P.in_flight(), F.lit("aborted")).otherwise(F.col("status")),
    })


def add_costs(calls: DataFrame, deltas: DataFrame) -> DataFrame:
    """Adds auxiliary cost per call to the total, reading a missing total as 0."""
    extra = deltas.groupBy(F.col("call_id").alias("id")).agg(F.sum("cost_usd").alias("__extra"))
    total = F.when(F.col("__extra").isNull(), F.col("total_cost_usd")).otherwise(
        F.coalesce("total_cost_usd", F.lit(0.0)) + F.col("__extra")
    )
    return calls.join(extra, "id", "left").withColumn("total_cost_usd", total).drop("__extra")


def purge_candidates(calls: DataFrame, texts: Sequence[str] | None) -> DataFrame:
    """Ownerless calls to delete: all of them, or (with ``texts``) non-A/B ones with a listed transcript."""
    ownerless = calls.where(F.col("owner_id").isNull())
    if texts is None:
        return ownerless
    return ownerless.where(F.col("ab_run_id").isNull() & F.col("redacted_transcript").isin(*texts))


def purge(calls: DataFrame, children: dict[str, DataFrame], texts: Sequence[str] | None) -> dict[str, DataFrame]:
    """Tables that remain after deleting the candidates and their child rows."""
    doomed = purge_candidates(calls, texts).select("id")
    kept = {"calls": calls.join(doomed, "id", "left_anti")}
    for name, child in children.items():
        kept[name] = child.join(doomed.withColumnRenamed("id", "call_id"), "call_id", "left_anti")
    return kept


def purge_counts(calls: DataFrame, children: dict[str, DataFrame], texts: Sequence[str] | None) -> DataFrame:
    """Dry run: rows per table that would be deleted."""
    doomed = purge_candidates(calls, texts).select("id")
    count = lambda df, name: df.agg(F.count("*").alias("n_deleted")).select(F.lit(name).alias("table_name"), "n_deleted")
    out = count(doomed, "calls")
    for name, child in children.items():
        out = out.unionByName(count(child.join(doomed.withColumnRenamed("id", "call_id"), "call_id", "left_semi"), name))
    return out


# ----------------------------------------------------------------- aggregates


def tenant_summary(calls: DataFrame, as_of: Column) -> DataFrame:
    agg = calls.groupBy("owner_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(P.in_flight()).alias("in_flight"),
        F.coalesce(F.avg(seconds_between("started_at", "ended_at")), F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce(F.sum("total_cost_usd"), F.lit(0.0)).alias("total_cost_usd"),
        F.count_if(F.col("started_at") > as_of - hours(24)).alias("used_24h"),
    )
    done = F.col("total") - F.col("in_flight")
    return agg.withColumn("failure_rate", F.coalesce(ratio("failed", done) * 100, F.lit(0.0)))


def impact_totals(calls: DataFrame) -> DataFrame:
    cost = F.col("total_cost_usd")
    healthy = (F.col("status") == "completed") & F.col("injected_fault").isNull()
    return calls.where(P.finished()).groupBy("owner_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("injected_fault").isNotNull()).alias("injected"),
        F.avg(F.when(healthy, cost)).alias("avg_ok"),
        F.avg(F.when(F.col("status") == "failed", cost)).alias("avg_failed"),
    )


def impact_projection(totals: DataFrame, calls_per_day: str | Column, failure_rate_pct: str | Column) -> DataFrame:
    """Monthly cost of failures at an assumed volume and failure rate."""
    with_basis = totals.select(
        "*",
        F.when(F.col("avg_ok").isNotNull(), F.lit("your_calls")).otherwise(F.lit("reference")).alias("basis"),
        F.coalesce("avg_ok", F.lit(V.REFERENCE_CALL_COST_USD)).alias("avg_call_usd"),
        (col(calls_per_day) * 30).cast("double").alias("monthly_calls"),
    )
    failures = F.col("monthly_calls") * col(failure_rate_pct) / 100.0
    sized = with_basis.select(
        "*", F.coalesce("avg_failed", "avg_call_usd").alias("avg_failed_call_usd"), failures.alias("monthly_failures")
    )
    wasted = F.col("monthly_failures") * F.col("avg_failed_call_usd")
    retry = F.col("monthly_failures") * F.col("avg_call_usd")
    return sized.select(
        "*",
        (F.col("monthly_calls") * F.col("avg_call_usd")).alias("monthly_spend_usd"),
        wasted.alias("wasted_usd"), retry.alias("retry_usd"), (wasted + retry).alias("monthly_impact_usd"),
    )


def cost_by_failure(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = calls.where((F.col("status") == "failed") & F.col("total_cost_usd").isNotNull() & F.col("predicted_category").isNotNull())
    return rows.groupBy(*by, F.col("predicted_category").alias("fault_type")).agg(
        F.count("*").alias("n"), F.avg("total_cost_usd").alias("avg_cost_usd"),
        F.min("total_cost_usd").alias("min_cost_usd"), F.max("total_cost_usd").alias("max_cost_usd"),
    ).orderBy(*by, F.desc("n"), "fault_type")


def cost_by_stage(calls: DataFrame, stages: DataFrame, monthly_calls: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean cost per (stage, provider), its share of the summed means, and the monthly projection."""
    healthy = calls.where(P.healthy_call()).select(F.col("id").alias("call_id"), *by)
    priced = stages.where(F.col("cost_usd").isNotNull() & F.col("provider").isNotNull()).select("call_id", "stage", "provider", "cost_usd")
    means = priced.join(healthy, "call_id").groupBy(*by, "stage", "provider").agg(
        F.count("*").alias("n"), F.avg("cost_usd").alias("avg_cost")
    )
    everything = F.sum("avg_cost").over(W.partitionBy(*(by or [F.lit(0)])))
    return means.select(
        *by, "stage", "provider", "n", "avg_cost",
        F.coalesce(ratio("avg_cost", everything), F.lit(0.0)).alias("share"),
        (F.col("avg_cost") * monthly_calls).alias("monthly_usd"),
    )


def stage_latency(calls: DataFrame, stages: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Percentiles of each main stage against its limit.

    Durations are whole milliseconds, so ``percentile`` keeps one counter per
    distinct value in its partial buffers and a hot stage is merged, not collected.
    """
    healthy = calls.where(P.healthy_call()).select(F.col("id").alias("call_id"), *by)
    rows = stages.where(P.measured_stage()).select("call_id", "stage", "duration_ms", "status").join(healthy, "call_id")
    return rows.groupBy(*by, "stage").agg(
        F.count("*").alias("n"),
        F.percentile("duration_ms", [0.5, 0.95]).alias("__p"),
        F.max("duration_ms").alias("max_ms"),
        F.count_if(F.col("status") == "timeout").alias("timeouts"),
        F.count_if(F.col("status") == "error").alias("errors"),
    ).select(
        *by, "stage", "n", F.col("__p")[0].alias("p50_ms"), F.col("__p")[1].alias("p95_ms"), "max_ms", "timeouts", "errors"
    )


def stage_limits_report(latency: DataFrame) -> DataFrame:
    """Every main stage, measured or not, with its limit, utilisation and alert flag."""
    spark = latency.sparkSession
    limits = spark.createDataFrame(list(V.STAGE_LIMIT_MS.items()), "stage string, limit_ms int")  # 3 fixed rows
    used = F.when(F.col("p95_ms").isNotNull(), F.least(F.lit(1.0), F.col("p95_ms") / F.col("limit_ms"))).otherwise(F.lit(0.0))
    return limits.join(latency, "stage", "left").select(
        "stage", "limit_ms", F.coalesce("n", F.lit(0)).alias("n"), "p50_ms", "p95_ms", "max_ms",
        F.coalesce("timeouts", F.lit(0)).alias("timeouts"), F.coalesce("errors", F.lit(0)).alias("errors"),
        used.alias("utilisation"), (used > 0.8).alias("alert"),
    )


def pipeline_seconds(stages: DataFrame) -> DataFrame:
    main = stages.where(P.in_set("stage", V.MAIN_STAGES))
    return main.groupBy("call_id").agg((F.sum("duration_ms") / 1000.0).alias("pipeline_s"))


def stage_shares(stages: DataFrame) -> DataFrame:
    """Cost and time share of each stage of a call, with the running cost arc in stage order."""
    per_stage = stages.groupBy("call_id", "stage").agg(
        F.sum("cost_usd").alias("cost_usd"), F.sum("duration_ms").cast("bigint").alias("duration_ms")
    )
    call = W.partitionBy("call_id")  # at most one row per stage name is left
    upto = call.orderBy(rank_in(V.STAGES, "stage")).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("cost_usd").over(call)
    end = F.sum("cost_usd").over(upto)
    return per_stage.select(
        "call_id", "stage",
        ratio("cost_usd", total).alias("cost_share"),
        ratio("duration_ms", F.sum("duration_ms").over(call)).alias("time_share"),
        ratio(end - F.col("cost_usd"), total).alias("arc_start"), ratio(end, total).alias("arc_end"),
    )


def recurring_failures(calls: DataFrame, as_of: Column, min_count: int = V.RECURRING_MIN_COUNT) -> DataFrame:
    """Failure categories seen in the last day, with the flag that marks a recurring one."""
    rows = calls.where((F.col("status") == "failed") & F.col("predicted_category").isNotNull() & (F.col("started_at") > as_of - hours(24)))
    return rows.groupBy("owner_id", F.col("predicted_category").alias("fault_type")).agg(F.count("*").alias("n")).withColumn(
        "recurring", F.col("n") >= min_count
    )


def without_fresh_suggestion(recurring: DataFrame, suggestions: DataFrame, as_of: Column) -> DataFrame:
    """Recurring failures that have no suggestion from the last two hours (null-safe on the category)."""
    fresh = suggestions.where(F.col("generated_at") > as_of - hours(V.SUGGESTION_FRESH_HOURS)).select(
        F.col("owner_id").alias("__o"), F.col("fault_type").alias("__f")
    ).distinct()
    same = (F.col("owner_id") == F.col("__o")) & F.col("fault_type").eqNullSafe(F.col("__f"))
    return recurring.join(fresh, same, "left_anti")


def suggestion_text() -> Column:
    # fixed value: wording of the rule-made suggestion
    return F.format_string(
        "%d recent %s failures observed; consider tightening the corresponding stage SLA or provider config.",
        F.col("n"), F.col("fault_type"),
    )


def recent_examples(calls: DataFrame, recurring: DataFrame, k: int = 10) -> DataFrame:
    """Newest ``k`` calls of every recurring category (a rank limit Spark also applies before the shuffle)."""
    pick = recurring.where("recurring").select("owner_id", F.col("fault_type").alias("predicted_category"))
    rank = F.row_number().over(W.partitionBy("owner_id", "predicted_category").orderBy(*newest_first()))
    return calls.join(pick, ["owner_id", "predicted_category"], "left_semi").withColumn("rank", rank).where(F.col("rank") <= k)


def spend_today(calls: DataFrame, side_ledger: DataFrame, as_of: Column, cap: float = V.DAILY_SPEND_CAP_USD) -> DataFrame:
    """Spend since midnight over the call ledger and the side ledger, against the daily cap."""
    both = calls.select(F.col("started_at").alias("at"), F.col("total_cost_usd").alias("cost_usd")).unionByName(
        side_ledger.select("at", "cost_usd")
    )
    today = both.where(F.col("at") >= F.date_trunc("day", as_of))
    return today.agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("spent_usd")).withColumn(
        "over_cap", F.col("spent_usd") >= cap
    )


def session_spend(costs: DataFrame, cap: float = V.SESSION_SPEND_CAP_USD) -> DataFrame:
    """Running session spend; negative amounts are ignored."""
    return costs.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("cost_usd"))), F.lit(0.0)).alias("spent_usd")).withColumn(
        "over_cap", F.col("spent_usd") >= cap
    )


def since(calls: DataFrame, bound: Column, at: str = "started_at", day: str = "call_date") -> DataFrame:
    """Rows after ``bound``. Where the table is cut by the day of ``at``, only the folders from the bound's day on are read; the bound may be known at run time only."""
    if day in calls.columns:
        calls = calls.where(F.col(day) >= F.to_date(bound))
    return calls.where(F.col(at) > bound)


def for_every_tenant(counts: DataFrame, tenants: DataFrame, zeros: Sequence[str]) -> DataFrame:
    """``counts`` by owner_id, with a row of zeros for each tenant that has none. Tenants may be null."""
    known = tenants.select(F.col("owner_id").alias("__owner"))
    joined = known.join(counts, F.col("__owner").eqNullSafe(F.col("owner_id")), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in zeros}).withColumn("owner_id", F.col("__owner")).drop("__owner")


def quota(calls: DataFrame, as_of: Column, limit: int = V.DAILY_CALL_LIMIT, tenants: DataFrame | None = None) -> DataFrame:
    """Calls of the last day and what is left of the quota. ``tenants``: those to report (owner_id); without it all that ever called, whose names are read from the whole history."""
    everyone = (calls if tenants is None else tenants).select("owner_id").distinct()
    used = since(calls, as_of - hours(24)).groupBy("owner_id").agg(F.count("*").alias("used"))
    return for_every_tenant(used, everyone, ["used"]).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("used")))


def counts_by(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def facet_groups(df: DataFrame, facet: str, order: Sequence[tuple[str, str]], default: str) -> DataFrame:
    """Non-empty groups of a facet in display order, with their labels."""
    labelled = df.groupBy(F.coalesce(F.col(facet), F.lit(default)).alias("facet")).agg(F.count("*").alias("n"))
    return labelled.select(
        rank_in([k for k, _ in order], "facet").alias("position"), "facet", lookup(dict(order), "facet").alias("label"), "n"
    ).where(F.col("label").isNotNull()).orderBy("position")


def merge_libraries(server: DataFrame, bundled: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Server rows win over bundled rows with the same key; extras are appended; fixed order."""
    extra = bundled.join(server.select(key), key, "left_anti")
    return server.unionByName(extra).withColumn("position", rank_in(order, key)).orderBy("position", key)
