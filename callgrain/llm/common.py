"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (a single machine, tests), one in the session's warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    return f"{_shared(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder and read from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared(df.sparkSession))
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds an expression to a name, so that lambdas in the body don't compute it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One identifier for each pair of identifiers; (a, b) and (b, a) differ."""
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x ^= b + np.uint64(0x165667B19E3779F9) + (x >> np.uint64(29))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


class Kept(dict):
    """Results of a function by argument; at most twice ``most``. What was not asked for while ``most`` others came is forgotten.

    Long arguments are not kept.
    """

    def __init__(self, fn: Callable, most: int = 200_000, longest: int = 48) -> None:
        super().__init__()
        self.fn, self.most, self.longest, self.older = fn, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


_IS_SPACE = np.isin(np.arange(256), list(SPACE.encode()))
_LETTER = mix(np.arange(256, dtype=np.uint64), np.full(1, 3, np.uint64))
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones((2, 1), np.uint64)


def _powers(n: int) -> np.ndarray:
    """Powers of _BASE and of its inverse modulo 2^64."""
    global _POWERS
    if _POWERS.shape[1] < n:
        steps = np.full((2, max(n, 1 << 19)), _BASE, np.uint64)
        steps[1] = pow(_BASE, -1, 1 << 64)
        steps[:, 0] = 1
        _POWERS = np.cumprod(steps, axis=1)
    return _POWERS


def word_ids(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the words of all texts in a row, A-Z in lower case, and the number of words of each text.

    A word's identifier is a polynomial in its bytes, from differences of running sums over the joined texts.
    """
    ids, counts, first, size = [], [], 0, 0
    for i, p in enumerate(parts):
        size += len(p) + 1
        if size >= 1 << 18 or i == len(parts) - 1:
            got, n = _word_ids(parts[first : i + 1])
            ids.append(got)
            counts.append(n)
            first, size = i + 1, 0
    return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.empty(0, np.uint64), np.empty(0, np.int64))


def _word_ids(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(parts).lower() + b" ", np.uint8)
    space = _IS_SPACE[data]
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    edges = change if space[0] else np.append(0, change)
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * power[: len(data)], out=sums[1:])
    ids = mix((sums[ends] - sums[starts]) * inverse[starts], (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0, *(len(p) + 1 for p in parts)])
    return ids, np.diff(np.searchsorted(starts, bounds))


def texts(column: pa.Array) -> Iterable[bytes]:
    """The UTF-8 bytes of each text; null is empty. One at a time, so that a batch is not held twice."""
    for x in column.cast(pa.binary()):
        yield x.as_py() or b""


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def arrays(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column from all values in a row and the length of each list."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
