"""Packing token sequences into windows, best fit in decreasing order of length.

Documents longer than a window are first cut into full windows; what is left of each is placed, longest first, into the
open window with the least room that still holds it. A segment tree over the remaining capacities finds that window in
log(capacity) steps. Each task packs what it reads in pools of ``pool`` remainders, so memory is bounded and no shuffle
is needed; an executor that is lost costs its task, which gives the same windows again.

A null text has no tokens of its own, only the end of the document. Repeated rows are packed like any others. An empty
table gives an empty result. Columns of the input other than id and text are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callgrain.llm.bpe import BYTE_PATTERN, Encoder, _read
from callgrain.llm.common import Kept, arrays

_FAST: dict[int, tuple[Encoder, Kept]] = {}


def fast_encoder(spec: str) -> tuple[Encoder, Kept]:
    """The ids of a byte-level tokenizer file, merged by a compiled library: packing needs ids, not the merging."""
    key = hash(spec)
    if key not in _FAST:
        e = Encoder(spec)
        ranks = {bytes(e.bytes_of[c] for c in s): i for s, i in e.vocab.items()}
        merge = tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _FAST[key] = (e, Kept(lambda chunk: np.array(merge(chunk), "<u4").tobytes(), most=250_000))
    return _FAST[key]


class OpenWindows:
    """Open windows by remaining capacity; a node of the tree counts those in its range."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        k = room + self.leaves
        while k:
            self.count[k] += by
            k >>= 1

    def put(self, window: int, room: int) -> None:
        self.at[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least ``need``, and its room."""
        k = need + self.leaves
        if not self.count[k]:
            while k > 1 and (k & 1 or not self.count[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.leaves:
                k = 2 * k if self.count[2 * k] else 2 * k + 1
        room = k - self.leaves
        self._add(room, -1)
        return self.at[room].pop(), room


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each length, and the number of windows; longest first, equal lengths in the given order."""
    tree, windows = OpenWindows(size), 0
    window, offset = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            found, windows = (windows, size), windows + 1
        window[i], room = found
        offset[i] = size - room
        if room > lengths[i]:
            tree.put(window[i], room - lengths[i])
    return window, offset, windows


def pack(df: DataFrame, path: str, size: int = 1024, key: str = "doc_id", text: str = "text", end: int = 0, pool: int = 16_384) -> DataFrame:
    """One row for each piece of a document: where it starts there, where it lies (sequence_id, offset) and its ids.

    ``path`` is a byte-level tokenizer file; ``end`` closes each document. sequence_id is the task's number times 2^32
    plus a count.
    """
    spec = df.sparkSession.sparkContext.broadcast(_read(path))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = fast_encoder(spec.value)
        base, used = TaskContext.get().partitionId() << 32, 0
        closing = np.array([end], "<u4").tobytes()
        rest: list[tuple] = []

        def rows(pieces: list[tuple], window: list[int], offset: list[int]) -> pa.RecordBatch:
            ids, starts, lengths, totals, values = zip(*pieces)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, key_type), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([base + w for w in window], pa.int64()), pa.array(offset, pa.int64()),
                 arrays(np.frombuffer(b"".join(values), "<u4").astype(np.int32), np.array(lengths, np.int32))],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        def flush() -> pa.RecordBatch:
            nonlocal used, rest
            window, offset, n = best_fit([p[2] for p in rest], size)
            out = rows(rest, [used + w for w in window], offset)
            used, rest = used + n, []
            return out

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            full: list[tuple] = []
            for k, t in zip(batch.column(0), batch.column(1)):
                got = encoder.encode(t.as_py() or "", known) + closing
                n, k = len(got) // 4, k.as_py()
                whole = n // size * size
                full += [(k, s, size, n, got[4 * s : 4 * (s + size)]) for s in range(0, whole, size)]
                if n > whole:
                    rest.append((k, whole, n - whole, n, got[4 * whole :]))
                if len(full) >= 4096:
                    yield rows(full, [used + i for i in range(len(full))], [0] * len(full))
                    used, full = used + len(full), []
                if len(rest) >= pool:
                    yield flush()
            if full:
                yield rows(full, [used + i for i in range(len(full))], [0] * len(full))
                used += len(full)
        if rest:
            yield flush()

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def ids_crc32(ids: Column) -> Column:
    """CRC-32 of the ids as little-endian 32-bit numbers."""

    def run(column: pa.Array) -> pa.Array:
        ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype("<u4")
        return pa.array([zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:])], pa.int64())

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(ids)
