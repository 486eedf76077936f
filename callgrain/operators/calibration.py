"""How well predicted labels match the ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions import predicates as P
from callgrain.functions.columns import fmt_count, ratio
from callgrain.operators.ledger import hours, newest_first


def labelled_calls(calls: DataFrame) -> DataFrame:
    """Finished calls with a known truth, as (… , truth, predicted)."""
    return calls.where(P.has_ground_truth()).withColumns({"truth": P.truth_label(), "predicted": F.col("predicted_category")})


def confusion(labelled: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return labelled.groupBy(*by, "truth", "predicted").agg(F.count("*").alias("n"))


def confusion_wide(labelled: DataFrame, labels: Sequence[str] = V.OUTCOMES) -> DataFrame:
    """One row per truth, one column per predicted label, zero where nothing was counted."""
    return labelled.groupBy("truth").pivot("predicted", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def label_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp/fp/fn, precision and recall over the union of actual and predicted labels.

    Works on the (small) confusion cells: every cell adds to one label when it
    is right and to two labels when it is wrong.
    """
    hit = F.col("truth") == F.col("predicted")
    n, zero = F.col("n"), F.lit(0).cast("bigint")
    as_actual = F.struct(
        F.col("truth").alias("label"), F.when(hit, n).otherwise(zero).alias("tp"), zero.alias("fp"),
        F.when(hit, zero).otherwise(n).alias("fn"), n.alias("actual"),
    )
    as_predicted = F.struct(
        F.col("predicted").alias("label"), zero.alias("tp"), F.when(hit, zero).otherwise(n).alias("fp"),
        zero.alias("fn"), zero.alias("actual"),
    )
    marks = cells.select(*by, F.inline(F.array(as_actual, as_predicted)))
    sums = marks.groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "actual")])
    return sums.select(
        "*", ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), ratio("tp", F.col("tp") + F.col("fn")).alias("recall")
    )


def overall(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    fault = F.when(F.col("truth") != "ok", F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    total = F.coalesce(F.sum("n"), zero)
    return cells.groupBy(*by).agg(
        total.alias("total"), F.coalesce(F.sum(fault), zero).alias("fault_runs"),
        (total - F.coalesce(F.sum(fault), zero)).alias("clean_runs"), F.coalesce(F.sum(right), zero).alias("correct"),
    ).withColumn("accuracy", F.coalesce(ratio("correct", "total"), F.lit(0.0)))


def right_of_row(cells: DataFrame) -> DataFrame:
    """For every injected fault: how many of its runs were diagnosed right."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    return cells.where("truth <> 'ok'").groupBy("truth").agg(F.sum(hit).alias("right_n"), F.sum("n").alias("row_n"))


def small_sample(summary: DataFrame) -> DataFrame:
    return summary.withColumn("small_sample", (F.col("total") > 0) & (F.col("fault_runs") < V.SMALL_SAMPLE_FAULT_RUNS))


def hourly_trend(labelled: DataFrame, as_of: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy per hour (of the last day when ``as_of`` is given); empty hours do not appear."""
    rows = labelled if as_of is None else labelled.where(F.col("started_at") > as_of - hours(24))
    return rows.groupBy(*by, F.date_trunc("hour", F.col("started_at")).alias("bucket")).agg(
        F.count("*").alias("total"), F.count_if(F.col("truth") == F.col("predicted")).alias("correct")
    )


def mistakes(labelled: DataFrame, k: int = 25) -> DataFrame:
    return labelled.where("truth <> predicted").orderBy(*newest_first()).limit(k)


def fault_diagnosis(cells: DataFrame) -> DataFrame:
    """Right share per injected fault, rule-made faults apart from model-dependent ones."""
    return right_of_row(cells).select(
        F.col("truth").alias("fault"), (~P.in_set("truth", V.MODEL_DEPENDENT_FAULTS)).alias("deterministic"),
        "right_n", "row_n", fmt_count("right_n", "row_n").alias("score"),
    )


def reference_distribution(calls: DataFrame, by: Sequence[str]) -> DataFrame:
    """Healthy share and cost spread per group; non-ok categories are listed with their counts."""
    per_label = calls.where("predicted_category IS NOT NULL").groupBy(*by, "predicted_category").agg(
        F.count("*").alias("c"), F.sum("total_cost_usd").alias("s"), F.min("total_cost_usd").alias("lo"), F.max("total_cost_usd").alias("hi")
    )
    other = F.when(F.col("predicted_category") != "ok", F.struct("predicted_category", "c"))
    listed = F.array_join(
        F.transform(F.array_sort(F.collect_list(other)), lambda x: F.concat(x["predicted_category"], F.lit(":"), x["c"].cast("string"))), ","
    )
    return per_label.groupBy(*by).agg(
        F.sum("c").alias("n"), F.sum(F.when(F.col("predicted_category") == "ok", F.col("c")).otherwise(0)).alias("ok"),
        listed.alias("other"), ratio(F.sum("s"), F.sum("c")).alias("avg_usd"), F.min("lo").alias("min_usd"), F.max("hi").alias("max_usd"),
    )
