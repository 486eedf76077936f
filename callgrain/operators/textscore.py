"""Corpus scores of transcripts against their scripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_accuracy(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Multiset overlap of ``ref_numbers`` and ``hyp_numbers`` per key: expected, matched, extra.

    Both sides become signed counts per number, so one shuffle on (key, number)
    replaces a full join; texts without any number do not appear.
    """
    side = lambda c, ref: F.transform(c, lambda n: F.struct(n.alias("n"), F.lit(ref).alias("r"), F.lit(1 - ref).alias("h")))
    long = rows.select(*key, F.inline(F.concat(side("ref_numbers", 1), side("hyp_numbers", 0))))
    cells = long.groupBy(*key, "n").agg(F.sum("r").alias("r"), F.sum("h").alias("h"))
    hit = F.sum(F.least("r", "h"))
    return cells.groupBy(*key).agg(F.sum("r").alias("expected"), hit.alias("matched"), (F.sum("h") - hit).alias("extra"))
