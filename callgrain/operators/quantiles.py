"""Exact nearest-rank quantiles for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank_by(
    df: DataFrame, by: Sequence[str], value: str, probs: Mapping[str, float], width: float
) -> DataFrame:
    """Element floor(n*p) of the sorted values of each group, without sorting a group.

    Equal values are counted, once for all that follows: the counts of a
    (group, bin of ``width``) are added up, the bin holding the wanted rank is
    found on the sums, and only the values of that bin are ranked. A hot group
    costs one bin of different values in the last step.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__bin", F.floor(F.col(value) / F.lit(float(width))))
    for k in [*by, "__bin"]:  # the joins below drop these; said here, both uses of the counts share one shuffle
        rows = rows.where(F.col(k).isNotNull())
    in_bin = rows.groupBy(*by, "__bin", value).agg(F.count("*").alias("__c"))
    counts = in_bin.groupBy(*by, "__bin").agg(F.sum("__c").alias("__n"))
    group = W.partitionBy(*by)
    upto = group.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)
    located = counts.select(
        *by, "__bin", F.sum("__n").over(upto).alias("__end"), F.sum("__n").over(group).alias("__total"), "__n"
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in probs.items()])
    target = F.least(F.col("__total") - 1, F.floor(F.col("__total") * F.col("__w.p")))
    start = F.col("__end") - F.col("__n")
    picks = (
        located.select("*", F.explode(wanted).alias("__w"))
        .where((target >= start) & (target < F.col("__end")))
        .select(*by, "__bin", F.col("__w.name").alias("__name"), (target - start).alias("__offset"))
    )
    seen = W.partitionBy(*by, "__bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    ranked = in_bin.join(picks.select(*by, "__bin").distinct(), [*by, "__bin"], "left_semi").select(
        *by, "__bin", value, F.sum("__c").over(seen).alias("__upto"), "__c"
    )
    hit = (F.col("__offset") < F.col("__upto")) & (F.col("__offset") >= F.col("__upto") - F.col("__c"))
    found = ranked.join(picks, [*by, "__bin"]).where(hit)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("__name") == n, F.col(value))).alias(n) for n in probs])


def percentile_spread(df: DataFrame, by: Sequence[str], value: str, lo: float, hi: float, width: float) -> DataFrame:
    out = nearest_rank_by(df, by, value, {"__lo": lo, "__hi": hi}, width)
    return out.select(*by, (F.col("__hi") - F.col("__lo")).alias("spread"))
