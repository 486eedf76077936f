"""Near-duplicate documents by SetSketch registers, banding, likelihood estimates and exact verification.

A document's set holds its distinct shingles of five words. Each of M registers keeps the least of exponentially
distributed hashes of the set, truncated to a whole number on an exponential scale: the maximum of two documents' registers
is the register of their union, and registers agree with a chance near the similarity. Registers are cut into bands, and
documents that share a band are candidates. Of each pair of candidates the similarity is estimated from all registers and
both set sizes by maximum likelihood; pairs that may reach the threshold are verified on their full sets.

Equal sets are one representative, so copies cost no pairs. Within a band's bucket candidates are tried in rounds: first
all members against one leader, then, while a bucket still holds members of several components, the rest in blocks
(see ``more_links``). Links are joined to components by alternating star contractions.

Null and empty texts, and texts without words, have no set, link with nothing and are kept. Rows are joined through their
sets, so rows that repeat an id, with the same text or another, are judged by their own text. A row with a null id takes
no part and is kept; its component is null. Other columns are not read. Texts of any length are read whole, one batch of texts of
about half a MB, or one longer text, at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import as_long, cut, mix, texts, word_ids

SHINGLE, M, ROWS = 5, 256, 5
BANDS = M // ROWS
#: Base of the register scale, its rate, and the greatest register value.
BASE, RATE, TOP = 1.001, 20.0, 65_535
#: How many ids may be broadcast, 8 bytes each.
FEW = 500_000
_SEEDS = mix(np.arange(1, M + 1, dtype=np.uint64), np.full(1, 77, np.uint64))
_FACTORS = mix(np.arange(1, M + 1, dtype=np.uint64), np.full(1, 78, np.uint64)) | np.uint64(1)


def shingles(parts: list[bytes]) -> list[np.ndarray]:
    """Sorted identifiers of the distinct shingles of each text; with fewer words, the whole sequence is one."""
    w, counts = word_ids(parts)
    ends = np.cumsum(counts)

    def of(words: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h = mix(h, words[k : len(words) - n + 1 + k])
        return h

    every = of(w, SHINGLE) if len(w) >= SHINGLE else w[:0]
    return [np.unique(every[b - n : b - SHINGLE + 1]) if n >= SHINGLE else of(w[b - n : b], int(n)) if n else w[:0] for n, b in zip(counts, ends)]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M registers for each set; no set may be empty."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    least = np.empty((len(sets), M), np.uint64)
    for k in range(M):
        least[:, k] = np.minimum.reduceat((every ^ _SEEDS[k]) * _FACTORS[k], starts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype("<u2")


def bands(rows: np.ndarray) -> np.ndarray:
    """Identifiers of the bands of each row of registers."""
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(rows), 1))
    cut_rows = rows[:, : BANDS * ROWS].reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        keys = mix(keys, cut_rows[:, :, k])
    return keys


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, steps: int = 40) -> np.ndarray:
    """Similarity of each pair of rows of registers by maximum likelihood, found by golden sections."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = size_a / (size_a + size_b)
    v = 1 - u

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _p(np.clip(u - v * j, 1e-12, 1)), _p(np.clip(v - u * j, 1e-12, 1))
        return more * np.log(up) + less * np.log(down) + (M - more - less) * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(steps):
        c, d = high - g * (high - low), low + g * (high - low)
        left = likelihood(c) > likelihood(d)
        low, high = np.where(left, low, c), np.where(left, d, high)
    return (low + high) / 2


def margin(threshold: float) -> float:
    """Pairs of a lower estimate are not verified: six standard deviations below the threshold."""
    return threshold - 6 * (threshold * (1 - threshold) / M) ** 0.5


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n, rep, registers) of each document; rep identifies its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, n = 0, [], 0

            def out(first: int, sets: list[np.ndarray], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                full = [s for s in sets if len(s)]
                rows = iter(registers(full)) if full else iter(())
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), batch.column(2).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(as_long(np.array([identity(s) for s in sets], np.uint64))),
                     pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=["doc_id", "text_hash", "n", "rep", "registers"])

            for i, t in enumerate(texts(batch.column(1))):
                held.append(t)
                n += len(t)
                if n >= 500_000 or i == batch.num_rows - 1:
                    yield out(first, shingles(held))
                    first, held, n = i + 1, [], 0

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, text_hash long, n long, rep long, registers binary")


def with_bands(reps: DataFrame) -> DataFrame:
    """(rep, n, band, key) for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column("registers").to_pylist()), "<u2").reshape(-1, M)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, batch.num_rows * BANDS + 1, BANDS, dtype=np.int32)), pa.array(as_long(bands(rows).ravel())))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), keys], names=["rep", "n", "keys"])

    return reps.select("rep", "n", "registers").mapInArrow(run, "rep long, n long, keys array<long>").select("rep", "n", F.posexplode("keys").alias("band", "key"))


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """The pairs (a, b) that reach the threshold. First by estimate, then on the full sets.

    The set of ``a`` goes to each block of its partners once and is held there while theirs stream by, so that an ``a``
    with very many partners is spread over tasks.
    """
    least = margin(percent / 100)
    sized = pairs.join(reps.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")), "a")
    sized = sized.join(reps.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b")), "b")
    sized = sized.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                r_a, r_b = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<u2").reshape(-1, M) for c in ("r_a", "r_b"))
                j = estimate(r_a, r_b, part.column("n_a").to_numpy().astype(float), part.column("n_b").to_numpy().astype(float))
                yield part.select(["a", "b"]).filter(pa.array(j >= least))

    candidates = cut(sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(likely, "a long, b long"))
    parts = candidates.groupBy("a").count().select("a", F.ceil(F.col("count") / block).alias("_parts"))
    placed = candidates.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "_parts").alias("_part"))
    left = placed.select(F.col("a").alias("rep"), F.col("a").alias("_at"), "_part", F.lit(False).alias("_right")).distinct()
    right = placed.select(F.col("b").alias("rep"), F.col("a").alias("_at"), "_part", F.lit(True).alias("_right"))
    involved = candidates.select(F.col("a").alias("rep")).union(candidates.select("b"))
    sets = _of_reps(docs, reps, involved, "set", lambda s: s.tobytes())
    moved = left.unionByName(right).join(sets, "rep").repartition("_at", "_part").sortWithinPartitions("_at", "_part", "_right")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for rep, where, part, is_right, raw in zip(*(batch.column(c) for c in ("rep", "_at", "_part", "_right", "set"))):
                found = np.frombuffer(raw.as_py(), "<u8")
                if not is_right.as_py():
                    at, held = (where.as_py(), part.as_py()), found
                    continue
                assert at == (where.as_py(), part.as_py())
                place = np.searchsorted(held, found).clip(0, len(held) - 1)
                both = int((held[place] == found).sum())
                if 100 * both >= percent * (len(held) + len(found) - both):
                    a.append(where.as_py())
                    b.append(rep.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return moved.select("rep", "_at", "_part", "_right", "set").mapInArrow(exact, "a long, b long")


def identity(s: np.ndarray) -> np.uint64:
    """One identifier of a set."""
    return np.bitwise_xor.reduce(mix(s, np.full(1, 5, np.uint64))) ^ mix(s, np.full(1, 6, np.uint64)).sum(dtype=np.uint64) if len(s) else np.uint64(0)


def _of_reps(docs: DataFrame, reps: DataFrame, wanted: DataFrame, name: str, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(rep, name): what ``make`` gives for the sets of the wanted representatives, from their texts.

    The ids of up to FEW of them are broadcast, so that the texts needn't move; more are joined.
    """
    ids = cut(wanted.distinct().join(reps.select("rep", "doc_id"), "rep").select("doc_id").distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                got = shingles([*texts(batch.column(0).slice(first, 1000))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.array([identity(s) for s in got], np.uint64))), pa.array([make(s) for s in got], pa.binary())], names=["rep", name])

    made = docs.join(ids, "doc_id", "left_semi").select("text").mapInArrow(run, f"rep long, {name} binary")
    return made.groupBy("rep").agg(F.first(name).alias(name))


def more_links(members: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, block: int = 4096) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and very likely reach the threshold.

    ``members``: key, band, rep and component of the buckets with several components. Members of a bucket fall into blocks
    by hash; each pair of blocks is compared by one task with array operations: first by registers, then by the leading 32
    bits of the shingles' identifiers, which can only make sets look more alike. Every pair of different components in a
    bucket is looked at, whatever the bucket's size, and leaves the task of the first band that it shares.
    """
    enough = int(np.floor(M * margin(percent / 100)))
    short = _of_reps(docs, reps, members.select("rep"), "short", lambda s: (s >> np.uint64(32)).astype("<u4").tobytes())
    blocks = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
    placed = members.join(blocks, "key").join(short, "rep").join(reps.select("rep", "registers"), "rep")
    placed = placed.withColumn("_own", F.pmod(F.xxhash64("rep"), "_blocks")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    placed = placed.select("key", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "rep", "component", "band", "registers", "short")

    def likely(rows: list[tuple], same_block: bool) -> tuple[np.ndarray, np.ndarray]:
        own, rep, component = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        band = rows[0][3]
        registers = np.frombuffer(b"".join(r[4] for r in rows), "<u2").reshape(-1, M)
        sets = [np.frombuffer(r[5], "<u4") for r in rows]
        n = np.array([len(s) for s in sets])
        left, right = [], []
        for i in range(len(rows) - 1):
            rest = slice(i + 1, None)
            fits = 100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i])
            others = np.flatnonzero(fits & (component[rest] != component[i]) & ((own[rest] != own[i]) | same_block)) + i + 1
            same = registers[others] == registers[i]
            some = same.sum(1) >= enough
            others, same = others[some], same[some]
            first = same[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(2).argmax(1)
            for j in others[first == band]:
                both = int((sets[i][np.searchsorted(sets[i], sets[j]).clip(0, n[i] - 1)] == sets[j]).sum())
                if 100 * both >= percent * (n[i] + n[j] - both):
                    left.append(rep[i])
                    right.append(rep[j])
        return np.array(left, np.int64), np.array(right, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []

        def out() -> pa.RecordBatch:
            a, b = likely(rows, at[1] == at[2])
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    if len(rows) > 1:
                        yield out()
                    at, rows = (key, i, j), []
                rows.append(row)
        if len(rows) > 1:
            yield out()

    return placed.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of the links (a, b) can reach, by alternating star contractions.

    Every round first looks whether the edges are stars already: each node has one edge at most to a smaller one, and none
    that has one is that of another. So links that come as stars cost one aggregation.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        seen = ends.groupBy("e.node").agg(F.sum("e.up").alias("ups"), F.count_if(F.col("e.up") == 0).alias("downs"))
        if seen.where("ups > 1 OR (ups > 0 AND downs > 0)").isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        edges = cut(joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct())


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row; documents link from ``percent`` per cent similarity on."""
    docs = docs.select("doc_id", "text")
    every = cut(sketches(docs))
    with_set = every.where("n > 0 AND doc_id IS NOT NULL")
    reps = cut(with_set.groupBy("rep").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("registers").alias("registers")))
    banded = with_bands(reps)
    leaders = banded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    members = cut(banded.join(leaders, "key").select("key", "band", "rep", "leader"))
    tried = cut(members.where("rep > leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut(verify(tried, docs, reps, percent))
    found = components(links)
    named = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "band", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    rest = more_links(cut(named.join(mixed, "key")), docs, reps, percent).join(tried, ["a", "b"], "left_anti")
    further = cut(verify(rest, docs, reps, percent))
    if not further.isEmpty():
        found = components(links.unionByName(further))
    rows = with_set.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "text_hash", "n", F.coalesce("component", "rep").alias("root"))
    ids = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = rows.join(ids, "root").select("doc_id", "text_hash", "n", "component_id")
    alone = every.where("n = 0 OR doc_id IS NULL").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return joined.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept, "text_hash")


def keep_one(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id, with all its columns.

    Of rows that repeat both id and text, one stays; rows with a null id all stay.
    """
    dropped = near_duplicates(docs, percent).where("NOT kept").select(F.col("doc_id").alias("dropped_id"), F.col("text_hash").alias("dropped_hash")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    left = rows.join(dropped, (F.col("id") == F.col("dropped_id")) & (F.col("hash") == F.col("dropped_hash")), "left_anti")
    place = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    return left.withColumn("place", place).where("place = 1 OR id IS NULL").select("row.*")
