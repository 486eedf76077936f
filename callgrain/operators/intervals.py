"""Range joins as equi joins on coarse time slots, and event matching."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain import vocab as V
from callgrain.functions.columns import rank_of, sorted_values
from callgrain.operators.sequence import per_key_stream, running_sum
from callgrain.sources.settle import settle


def slot_of(value: Column, width: int) -> Column:
    return F.floor(value / width).cast("bigint")


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, *, key: Sequence[str], point: Column, lo: str, hi: str,
    slot: int, how: str = "inner", slot_column: str | None = None, hashed: bool = False,
) -> DataFrame:
    """Joins each point to the intervals [lo, hi] of its key that contain it.

    An interval is listed once per time slot it touches and a point falls in
    exactly one slot, so a pair is found once and the join is an equi join on
    (key, slot); a hot key is spread over its slots. ``slot_column`` of the points holds
    their slot already: points dealt by (key, slot) are not dealt again. ``hashed``
    keeps the intervals of a task in a hash table, so the points, if they are many more, are not sorted.
    """
    sliced = intervals.select(
        *[F.col(k).alias(f"__k_{k}") for k in key], *[c for c in intervals.columns if c not in key],
        F.explode(F.sequence(slot_of(F.col(lo), slot), slot_of(F.col(hi), slot))).alias("__islot"),
    )
    if hashed:
        sliced = sliced.hint("shuffle_hash")
    own = slot_of(point, slot) if slot_column is None else F.col(slot_column)
    placed = points.withColumns({"__point": point, "__pslot": own})
    on = (F.col("__pslot") == F.col("__islot")) & (F.col("__point") >= F.col(lo)) & (F.col("__point") <= F.col(hi))
    for k in key:
        on = on & (F.col(k) == F.col(f"__k_{k}"))
    joined = placed.join(sliced, on, how)
    return joined.drop("__point", "__pslot", "__islot", *[f"__k_{k}" for k in key])


def widened(intervals: DataFrame, by_ms: int) -> DataFrame:
    """Intervals in doubled milliseconds, widened by a tolerance: midpoints stay whole numbers."""
    return intervals.withColumns({"lo2": F.col("start_ms") * 2 - 2 * by_ms, "hi2": F.col("end_ms") * 2 + 2 * by_ms}).drop("start_ms", "end_ms")


WORD = ["call_id", "turn", "pos"]


def scripted_speaker(words: DataFrame, truth: DataFrame, tolerance_ms: int = 50, slot_ms: int = 60_000) -> DataFrame:
    """(word key, who) for words whose midpoint lies in the lines of exactly one scripted speaker."""
    spans = widened(truth.select("call_id", "who", "start_ms", "end_ms"), tolerance_ms)
    hits = points_in_intervals(
        words.select(*WORD, "start_ms", "end_ms"), spans, key=["call_id"], point=F.col("start_ms") + F.col("end_ms"), lo="lo2", hi="hi2", slot=2 * slot_ms
    )
    one = hits.groupBy(*WORD).agg(F.min("who").alias("who"), F.max("who").alias("__other"))
    return one.where("who = __other").drop("__other")


def outside_script(words: DataFrame, truth: DataFrame, tolerance_ms: int = 300, slot_ms: int = 60_000) -> DataFrame:
    """Words whose midpoint lies in no scripted line: environment speech."""
    spans = widened(truth.select("call_id", "start_ms", "end_ms"), tolerance_ms)
    return points_in_intervals(words, spans, key=["call_id"], point=F.col("start_ms") + F.col("end_ms"), lo="lo2", hi="hi2", slot=2 * slot_ms, how="left_anti")


def frames_per_slot(hop_ms: float) -> int:
    """Frames in the slot that joins frames to spans: four seconds, which hold some ten words or two phrases."""
    return max(1, int(4000 / hop_ms))


def voiced_under(frames: DataFrame, spans: DataFrame, *, hop_ms: float, rounding: str = "cover") -> DataFrame:
    """Voiced frames joined to the spans they lie under, through (call_id, slot).

    Frames with a column ``frame_slot`` (``frame_idx div frames_per_slot``) that are dealt by (call_id, frame_slot) stay where they are.
    """
    dealt = "frame_slot" if "frame_slot" in frames.columns else None
    first, last = F.col("start_ms") / hop_ms, F.col("end_ms") / hop_ms
    if rounding == "cover":
        first, last = F.floor(first), F.ceil(last) - 1
    else:
        first, last = F.floor(first + 0.5), F.floor(last + 0.5) - 1
    ranged = spans.withColumns({"__lo": F.greatest(F.lit(0), first).cast("bigint"), "__hi": last.cast("bigint")}).where("__hi >= __lo")
    voiced = frames.where((F.col("f0") > 0) & (F.col("db") > F.col("floor_db") + V.VOICED_ABOVE_FLOOR_DB))
    out = points_in_intervals(
        voiced, ranged.drop("start_ms", "end_ms"), key=["call_id"], point=F.col("frame_idx"), lo="__lo", hi="__hi",
        slot=frames_per_slot(hop_ms), slot_column=dealt, hashed=True,
    )
    return out.drop("__lo", "__hi", "frame_slot")


def span_features(
    frames: DataFrame, spans: DataFrame, *, span_key: Sequence[str], hop_ms: float, rounding: str = "cover", with_cep: bool = False
) -> DataFrame:
    """Pitch and level of the voiced frames under each span.

    ``frames``: (call_id, frame_idx, f0, db, floor_db[, cep][, frame_slot]); ``spans``: (*span_key, start_ms, end_ms),
    with call_id in the key. ``cover`` takes frames floor(start/hop) .. ceil(end/hop) (exclusive end),
    ``round`` rounds both ends. The join key is (call_id, slot of four seconds); the frames of a span are
    bounded by its length.
    """
    pairs = voiced_under(frames, spans.select(*span_key, "start_ms", "end_ms"), hop_ms=hop_ms, rounding=rounding)
    aggs = [F.count("*").alias("frames"), sorted_values("f0").alias("__f0"), sorted_values("db").alias("__db")]
    if with_cep:
        aggs.append(F.array(*[F.avg(F.col("cep")[i]) for i in range(12)]).alias("cep"))
    measured = pairs.groupBy(*span_key).agg(*aggs).select(
        *span_key, "frames", rank_of("__f0", 0.5).alias("f0_median"), rank_of("__f0", 0.1).alias("f0_p10"), rank_of("__f0", 0.9).alias("f0_p90"),
        rank_of("__db", 0.5).alias("level_db"), *(["cep"] if with_cep else []),
    )
    return spans.join(measured, list(span_key), "left").withColumn("frames", F.coalesce("frames", F.lit(0)))


# --------------------------------------------------------------- event matching


def match_events(truth: DataFrame, detected: DataFrame, *, key: str, tolerance: int, span: int) -> DataFrame:
    """Each truth event takes the first unused detection within +-tolerance.

    Both inputs: (key, at, kind). Detections are taken in their order, so all that an event has to know of the
    earlier ones is the position of the next detection that is free. Time is cut into cells of ``span`` (two tolerances
    at least):

    1. a cell is summarised as a step function from the next free position at its start to that at its end;
    2. the step functions of a key are chained in order, which sees a few numbers per cell;
    3. every cell matches its own events from its now known start.

    A key with very many events is spread over its cells. Returns one row per event:
    (key, side, at, kind, matched, kind_right).
    """
    span = max(span, 2 * tolerance)
    key_type = truth.schema[key].dataType.simpleString()
    event = [F.col(key).alias("key"), F.col("at").cast("bigint").alias("at"), "kind"]
    cell = lambda c: F.floor(c / span).cast("bigint")
    numbered = running_sum(
        detected.select(*event).withColumn("chunk", cell(F.col("at"))), key=["key"], chunk="chunk", order=["at", "kind"], sums={"pos": F.lit(1).cast("bigint")}
    )
    # a detection is within reach of the cells up to a tolerance away from it
    reached = F.explode(F.sequence(cell(F.col("at") - tolerance), cell(F.col("at") + tolerance)))
    found = numbered.select("key", reached.alias("cell"), F.lit(1).alias("side"), "at", "kind", "pos")
    wanted = truth.select(*event).select("key", cell(F.col("at")).alias("cell"), F.lit(2).alias("side"), "at", "kind", F.lit(None).cast("bigint").alias("pos"))
    feed = settle(found.unionByName(wanted))

    def laid_out(rows: DataFrame) -> DataFrame:
        return rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "side", "at", "kind", "pos")

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _cells(batches):
            if not len(c.truth_at) or not len(c.at):
                continue
            # what earlier cells may have used lies before the start of this one and a tolerance
            starts = np.arange(c.first, c.first + np.searchsorted(c.at, c.cell * span + tolerance, side="left") + 1)
            ends = c.ends(starts, tolerance)
            last = np.append(np.diff(ends) != 0, True)
            yield pd.DataFrame({"key": c.key, "cell": c.cell, "until": starts[last], "free": ends[last]})

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free, at, taken = 0, None, False
        for b in batches:
            rows = []
            for k, c, until, end in zip(b["key"], b["cell"], b["until"], b["free"]):
                if c != at:
                    at, taken = c, False
                    rows.append((k, c, free))
                if not taken and until >= free:
                    free, taken = end, True
            yield pd.DataFrame(rows, columns=["key", "cell", "free"])

    steps = laid_out(feed).mapInPandas(summarise, f"key {key_type}, cell bigint, until bigint, free bigint")
    ordered = steps.repartition("key").sortWithinPartitions("key", "cell", "until")
    entries = per_key_stream(ordered, chain, f"key {key_type}, cell bigint, free bigint")
    started = entries.select("key", "cell", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("string").alias("kind"), F.col("free").alias("pos"))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in _cells(batches):
            used = c.used(tolerance)
            hit = used >= 0
            right = np.zeros(len(used), bool)
            right[hit] = c.kind[used[hit] - c.first] == c.truth_kind[hit]
            yield pd.DataFrame({"key": c.key, "at": c.truth_at, "kind": c.truth_kind, "pos": used, "kind_right": right})

    matches = settle(laid_out(feed.unionByName(started)).mapInPandas(match, f"key {key_type}, at bigint, kind string, pos bigint, kind_right boolean"))
    taken = matches.where("pos >= 0").select("key", "pos", F.lit(True).alias("taken"))
    own = found.where(F.col("cell") == cell(F.col("at"))).join(taken, ["key", "pos"], "left")
    return matches.select(F.col("key").alias(key), F.lit("truth").alias("side"), "at", "kind", (F.col("pos") >= 0).alias("matched"), "kind_right").unionByName(
        own.select(F.col("key").alias(key), F.lit("detected").alias("side"), "at", "kind", F.col("taken").isNotNull().alias("matched"), F.lit(False).alias("kind_right"))
    )


@dataclass
class _Cell:
    """The events of a cell in order. ``first``: the position of the first detection within reach; ``free``: that of the next unused one."""

    key: object
    cell: int
    free: int
    first: int
    at: np.ndarray
    kind: np.ndarray
    truth_at: np.ndarray
    truth_kind: np.ndarray

    def reach(self, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first detection within reach of each truth event, and of the first one beyond it."""
        low = np.searchsorted(self.at, self.truth_at - tolerance, side="left")
        return low + self.first, np.searchsorted(self.at, self.truth_at + tolerance, side="right") + self.first

    def ends(self, free: np.ndarray, tolerance: int) -> np.ndarray:
        """The next free position after the cell for each (rising) one before it. They never change order, and those that meet stay together."""
        low, high = self.reach(tolerance)
        groups = np.arange(len(free))
        k = 0
        while k < len(low) and len(free) > 1:
            free = np.maximum(free, low[k])
            free = free + (free < high[k])
            k += 1
            if free[0] == free[-1] or k % 16 == 0:
                free, place = np.unique(free, return_inverse=True)
                groups = place[groups]
        at = int(free[0])
        if len(free) == 1:
            for a, b in zip(low[k:].tolist(), high[k:].tolist()):
                at = max(at, a)
                at += at < b
            free = np.array([at])
        return free[groups]

    def used(self, tolerance: int) -> np.ndarray:
        """The position that each truth event takes; -1 for none."""
        out, at = [], self.free
        for a, b in zip(*(x.tolist() for x in self.reach(tolerance))):
            at = max(at, a)
            out.append(at if at < b else -1)
            at += at < b
        return np.array(out, dtype=np.int64)


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[_Cell]:
    """The cells of rows clustered by (key, cell) and sorted by (side, at, kind, pos)."""

    def made(rows: pd.DataFrame) -> _Cell:
        side = rows["side"].to_numpy()
        start, found, truth = (rows[side == k] for k in range(3))
        (at, kind), (truth_at, truth_kind) = ((x["at"].to_numpy(np.int64), x["kind"].to_numpy(object)) for x in (found, truth))
        first = int(found["pos"].iloc[0]) if len(found) else 0
        return _Cell(rows["key"].iloc[0], int(rows["cell"].iloc[0]), int(start["pos"].iloc[0]) if len(start) else 0, first, at, kind, truth_at, truth_kind)

    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        change = np.flatnonzero((b["key"].to_numpy()[1:] != b["key"].to_numpy()[:-1]) | (b["cell"].to_numpy()[1:] != b["cell"].to_numpy()[:-1])) + 1
        for lo, hi in zip([0, *change], [*change, len(b)]):
            piece = b.iloc[lo:hi]
            if held and (held[0]["key"].iloc[0] != piece["key"].iloc[0] or held[0]["cell"].iloc[0] != piece["cell"].iloc[0]):
                yield made(pd.concat(held))
                held = []
            held.append(piece)
    if held:
        yield made(pd.concat(held))


def detection_scores(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp / fn / fp, recall, precision and how often the kind was right."""
    truth = F.col("side") == "truth"
    tp, fn, fp = F.count_if(truth & F.col("matched")), F.count_if(truth & ~F.col("matched")), F.count_if(~truth & ~F.col("matched"))
    return matched.groupBy(*by).agg(tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), F.count_if("kind_right").alias("kind_right")).select(
        "*", F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"),
        F.try_divide(F.col("tp").cast("double"), F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"),
    )
