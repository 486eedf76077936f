"""Removing long repeated byte strings by bucket-pointer refinement.

Suffixes are put into buckets by the identifier of their first q bytes, and buckets are refined by the identifiers of later
offsets: the identifier of 2q bytes is made of those of q bytes at two offsets, and so on up to LENGTH bytes, each step
reusing the one before. Identifiers depend on content alone, so buckets of different tasks and documents can be joined, and
equal suffixes of different documents meet in a shuffle.

Not every suffix is moved. Of the windows of Q bytes inside each string of LENGTH bytes, the one of least identifier is the
string's anchor; equal strings have their anchors at the same place. One row for each anchor goes to its bucket, with the
identifier of the whole stretch of strings that it anchors. Buckets of one row end there. If all rows of a bucket agree on
the stretch, all its strings repeat. Only buckets whose rows differ are refined further, down to LENGTH bytes at each
offset, with one row for each different stretch. Large buckets are parted by the identifiers that are compared, so no task
holds a whole one.

Null and empty texts, and those shorter than LENGTH bytes, lose nothing. Equal texts are told by a 64-bit hash, lose the
same bytes and move once where the refined buckets ask for them; rows that repeat an id are judged by their own text. An
empty table gives an empty result. Other columns of the input are kept; those that clash with result columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from callgrain.llm.common import arrays, as_long, cut, mix, texts

LENGTH, Q = 200, 50
WINDOWS = LENGTH - Q + 1
CHUNK = 1 << 19
#: How many text keys may be broadcast, 8 bytes each.
FEW = 500_000
_LOW = np.uint64((1 << 24) - 1)
#: Strings whose anchors are looked for at a time, so that places fit _LOW and memory is bounded in texts of any length.
SLICE = 1 << 23


class Buckets:
    """Bucket identifiers at every offset of a stretch of bytes, for Q and for LENGTH bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((n,), "<u8", padded.tobytes(), 0, (1,))
        at = mix(eight, np.full(1, 8, np.uint64))
        at = mix(at[:-8], at[8:])
        at = mix(at[:-16], at[16:])
        self.short = mix(at[: n - Q + 1], at[Q - 32 : n - 31])
        at = mix(at[:-32], at[32:])
        at = mix(at[:-64], at[64:])
        self.long = mix(at[: n - LENGTH + 1], at[LENGTH - 128 : n - 127])


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` values in a row, from running minima of blocks forwards and backwards."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text number, bucket, stretch identifier, and first and last string of each anchor, counted from the text's start.

    ``data`` holds whole texts, each of at least LENGTH bytes, in a row.
    """
    parts = []
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        end = min(at + SLICE + LENGTH - 1, len(data))
        t = np.flatnonzero(np.minimum(ends, end) - np.maximum(starts, at) >= LENGTH)
        if len(t):
            found, bucket, stretch, lo, hi = _anchors(data[at:end], np.maximum(starts[t], at) - at, np.minimum(ends[t], end) - at)
            t = t[found]
            parts.append((t, bucket, stretch, lo + at - starts[t], hi + at - starts[t]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same for one slice, with strings counted from its start."""
    b = Buckets(data)
    place = np.arange(len(b.short), dtype=np.uint64)
    least = _sliding_least((b.short & ~_LOW) | (_LOW - place), WINDOWS)
    strings = np.concatenate([np.arange(s, e - LENGTH + 1) for s, e in zip(starts, ends)])
    text = np.repeat(np.arange(len(starts)), ends - starts - LENGTH + 1)
    anchor = (_LOW - (least[strings] & _LOW)).astype(np.int64)
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    last = np.append(first[1:], len(strings)) - 1
    lo, hi, a, t = strings[first], strings[last], anchor[first], text[first]
    shape = ((a - lo) << 16 | (hi - lo)).astype(np.uint64)
    return t, b.short[a], mix(mix(b.long[lo], b.long[hi]), shape), lo, hi


def _long_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Keys and joined bytes of runs of texts of at least LENGTH bytes."""
    for batch in batches:
        keys, parts, n = [], [], 0
        for k, t in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            if len(t) >= LENGTH:
                keys.append(k)
                parts.append(t)
                n += len(t)
            if n >= CHUNK:
                yield keys, *_joined(parts)
                keys, parts, n = [], [], 0
        if keys:
            yield keys, *_joined(parts)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(p) for p in parts])
    return np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends


def anchor_rows(rows: DataFrame) -> DataFrame:
    """(bucket, stretch, text_key, lo, hi) of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, starts, ends in _long_texts(batches):
            t, bucket, stretch, lo, hi = anchors(data, starts, ends)
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_long(bucket)), pa.array(as_long(stretch)), pa.array(np.array(keys, np.int64)[t]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                names=["bucket", "stretch", "text_key", "lo", "hi"])

    return rows.select("text_key", "text").mapInArrow(run, "bucket long, stretch long, text_key long, lo int, hi int")


def string_rows(wanted: DataFrame) -> DataFrame:
    """(bucket, part, stretch, copies, at, ids) for the wanted stretches: the identifiers of their strings.

    ``wanted``: text_key, text and a list of stretches. Strings of a bucket of many rows are parted by their identifiers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out: list[tuple] = []
            for key, text, listed in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2)):
                if key in seen:
                    continue
                seen.add(key)
                data = np.frombuffer(text, np.uint8)
                long = Buckets(data).long if len(data) <= SLICE else None
                for x in listed.as_py():
                    ids = long[x["lo"] : x["hi"] + 1] if long is not None else Buckets(data[x["lo"] : x["hi"] + LENGTH]).long
                    at = np.arange(x["hi"] - x["lo"] + 1, dtype=np.int32)
                    part = (ids % np.uint64(x["parts"])).astype(np.int32)
                    for p in np.unique(part) if x["parts"] > 1 else (0,):
                        here = part == p
                        out.append((x["bucket"], int(p), x["stretch"], x["copies"], at[here], ids[here]))
                if len(out) > 4096:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        bucket, part, stretch, copies, at, ids = zip(*out)
        n = np.array([len(x) for x in at], np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int64()), pa.array(part, pa.int32()), pa.array(stretch, pa.int64()), pa.array(copies, pa.int64()),
             arrays(np.concatenate(at), n), arrays(as_long(np.concatenate(ids)), n)], names=["bucket", "part", "stretch", "copies", "at", "ids"])

    return wanted.mapInArrow(run, "bucket long, part int, stretch long, copies long, at array<int>, ids array<long>")


def repeated_strings(strings: DataFrame) -> DataFrame:
    """(bucket, stretch, first, last): first and last string of each stretch that also starts elsewhere."""

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, at = batch.column(5).flatten().to_numpy(), batch.column(4).flatten().to_numpy()
        ends = batch.column(5).offsets.to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
        _, group = np.unique(ids, return_inverse=True)
        twice = np.bincount(group, batch.column(3).to_numpy()[row])[group] > 1
        row, at = row[twice], at[twice]
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.empty(0, int)
        last = np.append(starts[1:], len(row)) - 1 if len(row) else starts
        hit = pa.array(row[starts])
        return pa.RecordBatch.from_arrays([batch.column(0).take(hit), batch.column(2).take(hit), pa.array(at[starts]), pa.array(at[last])], names=["bucket", "stretch", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last bucket of a batch may go on in the next one
        held: list[pa.RecordBatch] = []
        for batch in batches:
            bucket, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and (held[-1].column(0)[0].as_py(), held[-1].column(1)[0].as_py()) != (bucket[0], part[0]):
                yield found(_one(held))
                held = []
            begin = np.flatnonzero((bucket != bucket[-1]) | (part != part[-1]))
            begin = int(begin[-1]) + 1 if len(begin) else 0
            if begin:
                yield found(_one([*held, batch.slice(0, begin)]))
                held = []
            held.append(batch.slice(begin))
        if held:
            yield found(_one(held))

    return strings.repartition("bucket", "part").sortWithinPartitions("bucket", "part").select("bucket", "part", "stretch", "copies", "at", "ids").mapInArrow(
        run, "bucket long, stretch long, first int, last int")


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def repeats(rows: DataFrame, bucket_rows: int = 2000) -> DataFrame:
    """(text_key, spans): the stretches of bytes [from, to) of each text that are covered by repeated strings, not merged."""
    every = anchor_rows(rows)
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("stretch").alias("x"), F.max("stretch").alias("y")).where("n > 1")
    shared = shared.select("bucket", "n", (F.col("x") == F.col("y")).alias("agree"))
    held = cut(every.join(shared, "bucket"))
    mixed = held.where("NOT agree").select("bucket", "stretch", "n", "text_key", "lo", "hi")
    # copies of the same stretch are one row from here on, counted
    one = mixed.groupBy("bucket", "stretch").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), F.min(F.struct("text_key", "lo", "hi")).alias("at"))
    listed = one.groupBy("at.text_key").agg(F.collect_list(F.struct(
        "bucket", "stretch", F.least("copies", F.lit(2)).alias("copies"), F.ceil(F.col("n") / bucket_rows).alias("parts"), "at.lo", "at.hi")).alias("listed"))
    listed = cut(listed)
    asked = rows.select("text_key", "text")
    if listed.count() <= FEW:  # else all texts are moved
        asked = asked.join(F.broadcast(listed.select("text_key")), "text_key", "left_semi")
    wanted = asked.join(listed, "text_key").select("text_key", "text", "listed")
    tested = repeated_strings(string_rows(wanted)).groupBy("bucket", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    refined = mixed.join(tested, ["bucket", "stretch"]).select("text_key", (F.col("lo") + F.col("first")).alias("from"), (F.col("lo") + F.col("last") + LENGTH).alias("to"))
    agreed = held.where("agree").select("text_key", F.col("lo").alias("from"), (F.col("hi") + LENGTH).alias("to"))
    return agreed.unionByName(refined).groupBy("text_key").agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans that neither touch nor overlap, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_letters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans without the letters that they hold in part only."""
    out = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def remove(docs: DataFrame, text: str = "text", letters: bool = False) -> DataFrame:
    """Adds ``spans``, the removed stretches of each text, and ``kept``, the bytes that are left.

    With ``letters``, letters of which only some bytes repeat stay, so that ``kept`` is text again.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    # the row is one column, so that no name of its own can clash
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64(content).alias("text_key"))
    found = repeats(docs.select(F.xxhash64(content).alias("text_key"), content.alias("text")))
    ready = keyed.join(found, "text_key", "left").select("row", "spans")
    schema = StructType([ready.schema["row"], *StructType.fromDDL("spans array<struct<from: int, to: int>>, kept binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                spans, kept = [], []
                for data, raw in zip(texts(part.column(0).field(text)), part.column(1)):
                    got = merged(raw.as_py())
                    if letters:
                        got = whole_letters(data, got)
                    spans.append([{"from": a, "to": b} for a, b in got])
                    edges = [0, *(x for s in got for x in s), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["row", "spans", "kept"])

    others = [f"row.`{c}`" for c in docs.columns if c not in ("spans", "kept")]
    return ready.mapInArrow(run, schema).select(*others, "spans", "kept")


def without_repeats(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows with what is left of their texts, and its length where the input has such a column. Texts may become empty."""
    # the other columns go by number inside one column, so that no name of theirs can clash with another or with that of the text
    names = [c for c in docs.columns if c != text]
    others = F.struct(F.lit(0).alias("c"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names))).alias("others")
    left = remove(docs.select(F.col(f"`{text}`").alias("text"), others), letters=True).select("others", F.col("kept").cast("string").alias("left"))
    made = {c: F.col(f"others.c{k}") for k, c in enumerate(names)} | {text: F.col("left")}
    if length in docs.columns:
        made[length] = F.length("left").cast(docs.schema[length].dataType)
    return left.select(*(made[c].alias(c) for c in docs.columns))
