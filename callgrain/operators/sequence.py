"""Ordered operators over (key, chunk): neighbours and running sums without one task per key.

A window partitioned by the key alone sends a hot key to a single task. Here
the rows of a key are cut into chunks of consecutive rows (a column the caller
supplies, e.g. ``turn div 64`` or an hour number). The window runs per
(key, chunk); only one small row per chunk takes part in the second window
over the key, and it is joined back on (key, chunk), the partitioning the big
side already has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(
    df: DataFrame, *, key: Sequence[str], chunk: str, order: Sequence[str], sums: Mapping[str, Column]
) -> DataFrame:
    """Adds inclusive running sums of each expression along ``order`` within ``key``."""
    part = [*key, chunk]
    inner = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = df.groupBy(*part).agg(*[F.sum(e).alias(f"__t_{n}") for n, e in sums.items()])
    before = W.partitionBy(*key).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(
        *part, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums]
    )
    inside = df.select("*", *[F.sum(e).over(inner).alias(f"__s_{n}") for n, e in sums.items()])
    out = inside.join(bases, part)
    return out.select(*df.columns, *[(F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.col(f"__b_{n}")).alias(n) for n in sums])


def neighbours(
    df: DataFrame,
    *,
    key: Sequence[str],
    chunk: str,
    order: Sequence[str],
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    among: Column | None = None,
) -> DataFrame:
    """Adds columns of the previous / following row of the key.

    ``previous`` maps new column name -> source column. ``is_first`` and
    ``is_last`` (within the key) are added for the directions asked for. With
    ``among`` only rows for which it holds count as neighbours.
    """
    part = [*key, chunk]
    position = F.struct(*order)
    at = position if among is None else F.when(among, position)

    def nearest(value: Column, by: Sequence[str], along: Sequence[str], backwards: bool) -> Column:
        """Closest earlier (or later) non-null value; frames always grow from the start, which stays linear."""
        w = W.partitionBy(*by).orderBy(*[F.desc(c) if backwards else F.asc(c) for c in along])
        if among is None:
            return F.lag(value).over(w)
        return F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))

    cols, edge_aggs, edge_cols, final = [], [], [], []
    for wanted, tag, backwards, flag in ((previous, "p", False, "is_first"), (following, "n", True, "is_last")):
        if not wanted:
            continue
        row = F.struct(*[F.col(src).alias(new) for new, src in wanted.items()])
        seen = row if among is None else F.when(among, row)
        cols.append(nearest(seen, part, order, backwards).alias(f"__{tag}"))
        edge_aggs.append((F.min_by if backwards else F.max_by)(row, at).alias(f"__edge_{tag}"))
        edge_cols.append(nearest(F.col(f"__edge_{tag}"), key, [chunk], backwards).alias(f"__far_{tag}"))
        got = F.coalesce(F.col(f"__{tag}"), F.col(f"__far_{tag}"))
        final += [got.getField(new).alias(new) for new in wanted] + [got.isNull().alias(flag)]
    edges = df.groupBy(*part).agg(*edge_aggs).select(*part, *edge_cols)
    return df.select("*", *cols).join(edges, part).select(*df.columns, *final)


Field = Callable[[str], Column]


def islands(
    df: DataFrame,
    *,
    key: Sequence[str],
    chunk: str,
    order: Sequence[str],
    uses: Sequence[str],
    starts: Callable[[Field, Field], Column],
    name: str,
) -> DataFrame:
    """Numbers runs of rows (1-based): a row opens a run when it is the first of its key or ``starts`` holds.

    ``starts(current, previous)`` gets two accessors over the columns in
    ``uses``. Flags and run numbers are made in one pass: a chunk is summarised
    as its first row, its last row and the runs opened inside it.
    """
    part = [*key, chunk]
    inner = W.partitionBy(*part).orderBy(*order)
    across = W.partitionBy(*key).orderBy(chunk)
    position, row = F.struct(*order), F.struct(*uses)
    field = lambda c: (lambda n: F.col(c).getField(n))
    opened = F.when(F.col("__p").isNotNull(), F.coalesce(starts(F.col, field("__p")), F.lit(False)).cast("bigint"))
    flagged = df.select("*", F.lag(row).over(inner).alias("__p")).withColumn("__open", F.coalesce(opened, F.lit(0)))
    chunks = flagged.groupBy(*part).agg(
        F.sum("__open").alias("__inside"), F.min_by(row, position).alias("__first"), F.max_by(row, position).alias("__last")
    ).withColumn("__before", F.lag("__last").over(across))
    head = F.when(F.col("__before").isNull(), F.lit(1)).otherwise(
        F.coalesce(starts(field("__first"), field("__before")), F.lit(False)).cast("bigint")
    )
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    bases = chunks.withColumn("__head", head.cast("bigint")).select(
        *part, (F.coalesce(F.sum(F.col("__head") + F.col("__inside")).over(earlier), F.lit(0)) + F.col("__head")).alias("__base")
    )
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    numbered = flagged.withColumn("__run", F.sum("__open").over(upto)).join(bases, part)
    return numbered.select(*df.columns, (F.col("__base") + F.col("__run")).alias(name))


def per_key_stream(ordered: DataFrame, fold, schema: str) -> DataFrame:
    """Runs ``fold`` once per key over rows already clustered and sorted, switching keys inside a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces():
            for b in batches:
                if len(b) == 0:
                    continue
                change = np.flatnonzero(b["key"].to_numpy()[1:] != b["key"].to_numpy()[:-1]) + 1
                for lo, hi in zip([0, *change], [*change, len(b)]):
                    yield b.iloc[lo:hi]

        stream = pieces()
        head = next(stream, None)
        while head is not None:
            current, box = head["key"].iloc[0], {"next": None}

            def one_key(first=head, current=current, box=box):
                yield first
                for piece in stream:
                    if piece["key"].iloc[0] != current:
                        box["next"] = piece
                        return
                    yield piece

            yield from fold(one_key())
            head = box["next"]

    return ordered.mapInPandas(run, schema)
