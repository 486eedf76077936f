"""Whitening of embeddings by an incremental eigendecomposition.

Vectors become whole numbers, so counts, sums and squared distances from the mean are exact. Each task keeps the
eigendecomposition (a spectrum) of the scatter of the rows it has seen and updates it by rank one: the mean moves, which
adds one vector, and a block of rows, centred at its own mean and turned by an orthogonal matrix (which leaves its scatter as
it is) to as many rows as there are dimensions, adds these. The new eigenvalues of each update are the roots of its secular
equation; directions that it doesn't touch and equal eigenvalues are deflated. Spectra of tasks are combined in the same
way, each eigenvector of the one being an update of the other, in rounds of ``FAN`` spectra a task. The basis that
results is refined by one distributed Rayleigh-Ritz step over all rows, centred exactly.

Rows whose vector is null or holds a null or a number that isn't finite are left out. Empty vectors too. Vectors of different lengths, or so
large that whole numbers in double precision end (2^53), raise an error. Where the scatter has fewer directions than
components are asked for (few, equal or constant rows), only those are given; a single row or equal rows give none.
Rows that repeat an id, or have none, are rows of their own. An empty table gives an empty result. Other columns are not read.
The state of a task is a square matrix of the number of dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callgrain.llm.common import cut

EPS = np.finfo(float).eps
#: Rows that are turned to an update together, spectra or matrices that are combined by one task, rows of a batch.
BLOCK, FAN = 4096, 16
#: How entries become whole numbers.
SCALE, SHIFT = 1024.0, 100_000
_STATE = "slot long, n long, sums array<string>, mean binary, eigenvalues binary, vectors binary"
_OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def secular(poles: np.ndarray, z: np.ndarray, steps: int = 80) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z_j^2 / (poles_j - x), one above each of the rising, different poles, for z without zeros.

    Each is given as its nearest pole (the index) and its distance from it, which keeps close ones apart. They are found
    from rational functions with the poles beside the root, within brackets that the sign of the function closes.
    """
    k, weight = len(poles), z * z
    upper = np.append(poles[1:], poles[-1] + weight.sum())
    gap = upper - poles
    middle = poles + gap / 2
    value = 1 + (weight / (poles - middle[:, None])).sum(1)
    at = np.where((value < 0) & (np.arange(k) < k - 1), np.arange(k) + 1, np.arange(k))
    delta = poles - poles[at][:, None]  # exact where poles are close
    below, above = poles - poles[at], upper - poles[at]  # the two poles beside the root, seen from the nearest
    low = np.where(at > np.arange(k), -gap / 2, np.where((value < 0), gap / 2, 0.0))
    high = np.where(at > np.arange(k), 0.0, np.where((value < 0), gap, gap / 2))
    x = (low + high) / 2
    left = np.tri(k, dtype=bool)  # poles up to the one below each root
    for _ in range(steps):
        terms = weight / (delta - x[:, None])
        slopes = terms / (delta - x[:, None])
        total, psi, phi = 1 + terms.sum(1), np.where(left, slopes, 0).sum(1), np.where(left, 0, slopes).sum(1)
        low, high = np.where(total < 0, x, low), np.where(total < 0, high, x)
        size = 1 + np.abs(terms).sum(1)
        d1, d2 = below - x, above - x
        c = total - d1 * psi - d2 * phi
        a = (d1 + d2) * total - d1 * d2 * (psi + phi)
        b = d1 * d2 * total
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(total) <= k * EPS * size) | (high - low <= 4 * EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        x = np.where(done, x, new)
    return at, x


@dataclass
class Spectrum:
    """Count, exact sums, mean, and the eigenvalues (rising) and eigenvectors (columns) of the scatter about the mean."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, [0] * d, np.zeros(d), np.zeros(d), np.eye(d))

    def update(self, v: np.ndarray) -> None:
        """The scatter plus the outer product of v with itself."""
        z = v @ self.vectors
        size = float(np.sqrt(z @ z))
        if not size:
            return
        values, vectors = self.values, self.vectors
        small = 8 * EPS * max(float(np.abs(values).max()), size * size)
        at = np.flatnonzero(np.abs(z) * size > small)
        if not len(at):
            return
        at = at[np.argsort(values[at], kind="stable")]
        if (np.abs(z[at[1:]] * z[at[:-1]]) * np.diff(values[at]) <= small * (z[at[1:]] ** 2 + z[at[:-1]] ** 2)).any():
            at = self._deflated(at, z, small)
        poles, z = values[at], z[at]
        nearest, offset = secular(poles, z)
        away = poles - poles[nearest][:, None] - offset[:, None]  # each pole less each root, a row for each root
        # the update that has exactly these roots, from the poles and roots alone, gives orthogonal vectors
        apart = np.where(np.tri(len(at), dtype=bool), np.append(poles[1:], 0)[:, None], poles[:, None]) - poles
        apart[-1] = 1
        exact = np.copysign(np.sqrt(np.abs(np.prod(away / apart, axis=0))), z)
        turn = exact / away
        turn /= np.sqrt((turn * turn).sum(1))[:, None]
        vectors[:, at] = vectors[:, at] @ turn.T
        values[at] = poles[nearest] + offset

    def _deflated(self, at: np.ndarray, z: np.ndarray, small: float) -> np.ndarray:
        """Of two nearly equal eigenvalues, a rotation of their vectors leaves the update to the one; ``z`` is turned too. Returns the places left, by rising value."""
        values, vectors, kept = self.values, self.vectors, []
        for j in at:
            if kept:
                i = kept[-1]
                r = np.hypot(z[i], z[j])
                c, s = z[j] / r, z[i] / r
                if abs(c * s) * (values[j] - values[i]) <= small:
                    one, two = vectors[:, i].copy(), vectors[:, j].copy()
                    vectors[:, i], vectors[:, j] = c * one - s * two, s * one + c * two
                    low, high = values[i], values[j]
                    values[i], values[j] = c * c * low + s * s * high, s * s * low + c * c * high
                    z[i], z[j] = 0.0, r
                    kept.pop()
            kept.append(j)
        return np.array(kept)[np.argsort(values[kept], kind="stable")]

    def add(self, n: int, sums: list[int], mean: np.ndarray, rows: np.ndarray) -> None:
        """Rows of this count, sums and mean, the scatter of which is that of ``rows``."""
        if not n:
            return
        if self.n:
            self.update((mean - self.mean) * np.sqrt(self.n * n / (self.n + n)))
        for row in rows:
            self.update(row)
        self.n += n
        self.sums = [a + b for a, b in zip(self.sums, sums)]
        self.mean = np.array([s / self.n for s in self.sums])

    def add_rows(self, x: np.ndarray) -> None:
        """Whole-number rows, a block at a time."""
        for first in range(0, len(x), BLOCK):
            part = x[first : first + BLOCK]
            sums = [int(s) for s in part.sum(0)]
            mean = np.array([s / len(part) for s in sums])
            self.add(len(part), sums, mean, np.linalg.qr(part - mean, mode="r"))

    def join(self, other: Spectrum) -> None:
        """All rows of another spectrum, from its eigenvectors."""
        self.add(other.n, other.sums, other.mean, (other.vectors * np.sqrt(np.maximum(other.values, 0))).T)

    def row(self, slot: int) -> tuple:
        return slot, self.n, [str(s) for s in self.sums], self.mean.tobytes(), self.values.tobytes(), self.vectors.tobytes()

    @classmethod
    def of(cls, r) -> Spectrum:
        values = np.frombuffer(r.eigenvalues).copy()
        return cls(int(r.n), [int(s) for s in r.sums], np.frombuffer(r.mean).copy(), values, np.frombuffer(r.vectors).reshape(len(values), -1).copy())


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows take part, and their vectors as whole numbers."""
    n = len(column)
    column = column.cast(pa.list_(pa.float64()))
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=ends[1:])
    entries = column.flatten()  # leaves out null lists
    flat = entries.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat) | entries.is_null().to_numpy(zero_copy_only=False))])
    keep = (np.diff(ends) > 0) & (bad[ends[1:]] == bad[ends[:-1]])
    lengths = np.unique(np.diff(ends)[keep])
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths[:5].tolist()}")
    scaled = np.floor(flat[np.repeat(keep, np.diff(ends))] * SCALE)
    if len(scaled) and np.abs(scaled).max() >= 2.0**53:
        raise ValueError("vectors too large for whole numbers in double precision")
    return keep, (scaled.astype(np.int64) + SHIFT).reshape(int(keep.sum()), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: 64-bit numbers, or Python's where those are too short."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row."""
    if len(y) and y.dtype == object or float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2.0**62:
        y = y.astype(object)
    return [int(v) for v in (y * y).sum(1)]


def _rounds(states: DataFrame, join: Callable[[pd.DataFrame], tuple]) -> DataFrame:
    """Rows of neighbouring slots joined, ``FAN`` at a time, until one is left."""
    states = cut(states)
    left = states.agg(F.coalesce(F.max("slot"), F.lit(-1))).first()[0] + 1
    names = states.columns

    def one(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(group[0], *join(rows.sort_values("slot"))[1:])], columns=names)

    while left > 1:
        states = states.groupBy(F.floor(F.col("slot") / FAN).cast("long").alias("g")).applyInPandas(one, states.schema)
        left = -(-left // FAN)
    return states


def spectrum(rows: DataFrame) -> Spectrum | None:
    """The spectrum of all rows of ``vector``; None where there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = None, [], 0

        def fold() -> None:
            nonlocal held, waiting, n
            x = np.concatenate(waiting)
            held = held or Spectrum.empty(x.shape[1])
            held.add_rows(x)
            waiting, n = [], 0

        for batch in batches:
            _, x = whole_numbers(batch.column(0))
            if len(x):
                waiting.append(x)
                n += len(x)
                if n >= BLOCK:
                    fold()
        if n:
            fold()
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, held.row(TaskContext.get().partitionId())))], schema)

    names = ["slot", "n", "sums", "mean", "eigenvalues", "vectors"]
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), *((c, pa.binary()) for c in names[3:])])

    def join(parts: pd.DataFrame) -> tuple:
        first, *others = map(Spectrum.of, parts.itertuples())
        for other in others:
            if len(other.values) != len(first.values):
                raise ValueError(f"vectors of different lengths: {len(first.values)}, {len(other.values)}")
            first.join(other)
        return first.row(0)

    found = _rounds(rows.select("vector").mapInArrow(run, _STATE), join).collect()
    return Spectrum.of(found[0]) if found else None


def second_moment(rows: DataFrame, n: int, sums: list[int], basis: np.ndarray) -> np.ndarray:
    """The covariance of all rows of ``vector`` in a basis, its columns. Rows are centred exactly, before they are multiplied."""
    given = rows.sparkSession.sparkContext.broadcast(basis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((basis.shape[1],) * 2)
        for batch in batches:
            _, x = whole_numbers(batch.column(0))
            if len(x):
                c = (deviations(x, n, sums) / n).astype(float) @ given.value
                total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["slot", "total"])

    def join(parts: pd.DataFrame) -> tuple:
        return 0, np.sum([np.frombuffer(t) for t in parts["total"]], axis=0).tobytes()

    found = _rounds(rows.select("vector").mapInArrow(run, "slot long, total binary"), join).first()
    return np.frombuffer(found["total"]).reshape(basis.shape[1], -1) / n


@dataclass
class Whitening:
    """What whitens: the number and sums of the rows, components (columns, by falling eigenvalue), eigenvalues, trace, and the measured identity error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return (y / self.n).astype(float) @ self.components / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = 8, accuracy: float = 1e-9, refinements: int = 4) -> Whitening | None:
    """From all rows of ``vector``. Rayleigh-Ritz steps are repeated until the covariance of the whitened rows is the identity to ``accuracy``; one is enough as a rule."""
    start = spectrum(rows)
    if start is None:
        return None
    basis, made = start.vectors, None
    for _ in range(refinements):
        basis = np.linalg.qr(basis)[0]
        values, turn = np.linalg.eigh(second_moment(rows, start.n, start.sums, basis))
        basis = (basis @ turn)[:, ::-1]
        values = values[::-1]
        top = int((values[:components] > len(values) * EPS * max(values[0], 0)).sum())
        if not top:
            return None
        best = basis[:, :top] / np.linalg.norm(basis[:, :top], axis=0)
        best = best * np.where(best[np.abs(best).argmax(0), np.arange(top)] < 0, -1, 1)
        made = Whitening(start.n, start.sums, best, values[:top], math.fsum(values), 0.0)
        made.identity_error = float(np.abs(second_moment(rows, start.n, start.sums, best / np.sqrt(values[:top])) - np.eye(top)).max())
        if made.identity_error <= accuracy:
            break
    return made


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """For each row that takes part and each component from 1: the id, component, n, deviation (sum over dimensions of (n x - S)^2, exact;
    null beyond 38 digits), whitened, explained (share of the variance) and identity_error (one value)."""
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("vector"))
    kind = rows.schema["id"].dataType.simpleString()
    made = fit(rows, components)
    schema = f"`{key}` {kind}, {_OUT}"
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    given, top = df.sparkSession.sparkContext.broadcast(made), len(made.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = given.value
        for batch in batches:
            keep, x = whole_numbers(batch.column(1))
            if not len(x):
                continue
            y = deviations(x, w.n, w.sums)
            far = [Decimal(v) if v < 10**38 else None for v in squares(y)]
            ids, m = batch.column(0).filter(pa.array(keep)), len(x) * top
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(np.repeat(np.arange(len(x)), top))), pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(x))), pa.array(np.full(m, w.n)),
                 pa.array(far, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(x)), top))), pa.array(w(y).ravel()),
                 pa.array(np.tile(w.values / w.trace, len(x))), pa.array(np.full(m, w.identity_error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)
