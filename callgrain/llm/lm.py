"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a logarithmic scale; a Bloom filter holds each key
once for every level up to that of its count. Probing the levels of a key in turn until one is missing gives its count
back, never too low. The chance of a word after another is its pair count, smoothed with the word's own chance:
(c(u, v) + m p(v)) / (c(u) + m).

The filter holds every word and pair of all training texts at every size: it is built in segments, each as large as its
entries need, by the task that has all counts of its keys, and the segments are kept in a table. At most ``filter_bytes`` of
them are broadcast at a time; where they are more, the texts are read once for each such round and the parts of their scores
are added up. For that, the pairs of a word lie in the segment of the word. Only those of the most frequent words, at most
``HOT``, are spread over all segments; the exact counts of these words are broadcast, for the base score too, and those of
all others are joined to it.

Null and empty texts have one token, their end. Texts are read whole. Rows with a null id are held out. Repeated rows
train and are scored each by itself. With no training rows, all counts are 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callgrain.llm.common import arrays, as_long, cut, mix, texts, word_ids

START, END, ALONE = np.uint64(0x5EED0001), np.uint64(0x5EED0002), np.uint64(0x5EED0003)
HOT = 1 << 18
STEP = 1.2
#: Least count of each level, distinct whole numbers growing by about STEP.
LEAST = np.unique(np.floor(STEP ** np.arange(0, 200)).astype(np.int64))
#: The count a level stands for: the geometric mean of its least and greatest.
MEANT = np.concatenate([[0.0], np.sqrt(LEAST.astype(float) * np.append(LEAST[1:] - 1, LEAST[-1]))])
PROBES = 4  # bits of an entry, all in one 64-bit word
CHUNK = 1_500_000
PART = 1 << 23  # bytes of the filter that are collected at a time
SEGMENT_TOKENS, SEGMENTS = 2_000_000, 1 << 16
#: The bits of a key that choose its segment.
LEAD = np.uint64((SEGMENTS - 1) << 48)


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def chunks(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """Batch, first row, token ids and number of tokens of each text, for a run of texts of about CHUNK bytes."""
    for batch in batches:
        first, got, n = 0, [], 0
        for i, t in enumerate(texts(batch.column(column))):
            got.append(t)
            n += len(t)
            if n >= CHUNK or i == batch.num_rows - 1:
                yield batch, first, *tokens(got)
                first, got, n = i + 1, [], 0


def tokens(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and ends of all texts in a row, and the number of tokens of each text."""
    ids, counts = word_ids(parts)
    lengths = counts + 1
    out = np.full(lengths.sum(), END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(lengths) - 1] = False
    out[is_word] = ids
    return out, lengths


def before(now: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The token before each token."""
    out = np.roll(now, 1)
    out[np.cumsum(lengths) - lengths] = START
    return out


def alone(words: np.ndarray) -> np.ndarray:
    """The key of each single word."""
    return mix(words, np.array([ALONE]))


def pairs(last: np.ndarray, now: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The key of each pair, in the segment of its second word unless that is frequent."""
    keys = mix(last, now)
    return np.where(frequent, keys, alone(now) & LEAD | keys & ~LEAD)


def known(hot: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each word among the sorted hot ones, and whether it is one of them."""
    at = np.searchsorted(hot, words).clip(0, max(len(hot) - 1, 0))
    return at, hot[at] == words if len(hot) else np.zeros(len(words), bool)


class Counter:
    """Counts of keys; new keys are merged into sorted ones now and then."""

    def __init__(self) -> None:
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(2_000_000, len(self.keys)):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
            order = np.argsort(keys, kind="stable")
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(keys) else counts
            self.waiting, self.size = [], 0
        return self.keys, self.counts


def word_counts(training: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(word, n): counts of token ids, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def out() -> pa.RecordBatch:
            k, n = counter.merge()
            return pa.RecordBatch.from_arrays([pa.array(as_long(k)), pa.array(n)], names=["word", "n"])

        for _, _, now, _ in chunks(batches):
            counter.add(now)
            if len(counter.keys) > most:
                yield out()
                counter = Counter()
        yield out()

    return training.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def segment_counts(training: DataFrame, segments: int, frequent: Broadcast | None = None, most: int = 3_000_000) -> DataFrame:
    """(segment, keys, counts): counts of pairs and of words that aren't frequent in each task, parted by the leading bits of the key."""
    shift = np.uint64(64 - segments.bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        hot = frequent.value[0] if frequent else np.empty(0, np.uint64)

        def out() -> pa.RecordBatch:
            keys, counts = counter.merge()
            edges = np.searchsorted(keys >> shift, np.arange(segments + 1, dtype=np.uint64))
            small = np.minimum(counts, 0xFFFFFFFF).astype("<u4")
            cuts = [(s, a, b) for s, a, b in zip(range(segments), edges, edges[1:]) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in cuts], pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in cuts], pa.binary()),
                 pa.array([small[a:b].tobytes() for _, a, b in cuts], pa.binary())], names=["segment", "keys", "counts"])

        for _, _, now, lengths in chunks(batches):
            _, is_hot = known(hot, now)
            counter.add(pairs(before(now, lengths), now, is_hot))
            counter.add(alone(now[~is_hot]))
            counter.add(alone(np.array([START])), np.array([len(lengths)]))
            if len(counter.keys) > most:
                yield out()
                counter = Counter()
        yield out()

    return training.select("text").mapInArrow(run, "segment int, keys binary, counts binary")


def place(keys: np.ndarray, level: int, words: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a key at a level, and the bits in it: one memory access tests all PROBES bits."""
    h = mix(keys, np.full(1, level, np.uint64))
    word = ((h >> np.uint64(32)) * words) >> np.uint64(32)
    mask = np.uint64(1) << (h & np.uint64(63))
    for k in range(1, PROBES):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return word, mask


def build_segments(counted: DataFrame, segments: int, bits_per_entry: int) -> DataFrame:
    """(segment, bits): the filter of each segment."""

    def one(parts: list[tuple[bytes, bytes]]) -> bytes:
        counter = Counter()
        for k, n in parts:
            counter.add(np.frombuffer(k, "<u8"), np.frombuffer(n, "<u4").astype(np.int64))
        keys, counts = counter.merge()
        level = np.searchsorted(LEAST, counts, "right")
        words = max(1, int(level.sum()) * bits_per_entry // 64)
        bits = np.zeros(words, "<u8")
        for q in range(1, int(level.max(initial=0)) + 1):
            word, mask = place(keys[level >= q], q, np.uint64(words))
            order = np.argsort(word)
            word, mask = word[order], mask[order]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            bits[word[first]] |= np.bitwise_or.reduceat(mask, first)
        return bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([one(parts)], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for s, k, n in zip(*batch.columns):
                if s.as_py() != current:
                    if parts:
                        yield out()
                    current, parts = s.as_py(), []
                parts.append((k.as_py(), n.as_py()))
        if parts:
            yield out()

    return counted.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(run, "segment int, bits binary")


class Filter:
    """The joined segments from ``first`` up to ``last``; ``count`` probes level after level, each key as long as it is found.

    Segments are ``parts``, or are put in one by one where their ``sizes`` in bytes are given.
    """

    def __init__(self, segments: int, parts: Mapping[int, bytes], first: int = 0, last: int | None = None, sizes: np.ndarray | None = None) -> None:
        self.first, self.last = first, segments if last is None else last
        self.shift = np.uint64(64 - segments.bit_length() + 1)
        sizes = np.array([len(parts.get(s, b"\0" * 8)) for s in range(segments)]) if sizes is None else sizes
        self.words = (sizes[self.first : self.last] // 8).astype(np.uint64)
        self.offset = np.concatenate([[0], np.cumsum(self.words)[:-1]]).astype(np.uint64)
        self.bytes = bytearray(8 * int(self.words.sum()))
        for segment, bits in parts.items():
            if self.first <= segment < self.last:
                self.put(segment, bits)

    def put(self, segment: int, bits: bytes) -> None:
        at = 8 * int(self.offset[segment - self.first])
        self.bytes[at : at + len(bits)] = bits

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key's segment is one of these."""
        segment = (keys >> self.shift).astype(np.int64)
        return (segment >= self.first) & (segment < self.last)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """The count of each key, 0 outside these segments."""
        data = np.frombuffer(self.bytes, "<u8")
        level = np.zeros(len(keys), np.int64)
        active = np.flatnonzero(self.holds(keys))
        keys = keys[active]
        segment = (keys >> self.shift).astype(np.int64) - self.first
        words, offset = self.words[segment], self.offset[segment]
        for q in range(1, len(LEAST) + 1):
            word, mask = place(keys, q, words)
            found = np.flatnonzero(data[word + offset] & mask == mask)
            if not len(found):
                break
            active, keys, words, offset = active[found], keys[found], words[found], offset[found]
            level[active] = q
        return MEANT[level]


class Segments:
    """The table of all segments, and the rounds in which they are probed: runs of segments of at most ``filter_bytes``."""

    def __init__(self, table: DataFrame, segments: int, filter_bytes: int) -> None:
        self.table, self.segments = table, segments
        self.sizes = np.full(segments, 8)
        for r in table.select("segment", F.octet_length("bits").alias("n")).collect():
            self.sizes[r["segment"]] = r["n"]
        self.rounds: list[tuple[int, int]] = []
        first = 0
        for s in range(1, segments + 1):
            if s == segments or self.sizes[first : s + 1].sum() > filter_bytes:
                self.rounds.append((first, s))
                first = s

    def filter(self, k: int) -> Filter:
        """The segments of a round."""
        first, last = self.rounds[k]
        made = Filter(self.segments, {}, first, last, self.sizes)
        # a few MB at a time, so that the driver holds little beside the filter itself
        at = first
        while at < last:
            stop = at + 1
            while stop < last and self.sizes[at : stop + 1].sum() <= PART:
                stop += 1
            for r in self.table.where(F.col("segment").between(at, stop - 1)).collect():
                made.put(r["segment"], r["bits"])
            at = stop
        return made

    @property
    def bytes(self) -> bytearray:
        """The bits of the largest round, the most that is held at a time."""
        return self.filter(max(range(len(self.rounds)), key=lambda k: self.sizes[slice(*self.rounds[k])].sum())).bytes


def build(training: DataFrame, tokens: int, filter_bytes: int = 1 << 26, bits_per_entry: int = 12, frequent: Broadcast | None = None) -> Segments:
    """All segments, so many that several fit ``filter_bytes``. A token adds two entries at most."""
    segments = 16
    while segments < SEGMENTS and (segments * SEGMENT_TOKENS < tokens or segments * filter_bytes < tokens * bits_per_entry):
        segments *= 2
    return Segments(cut(build_segments(segment_counts(training, segments, frequent), segments, bits_per_entry)), segments, filter_bytes)


def hot_words(counts: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words, at most ``most``: all those above the least count for which they are so few."""
    by_size = counts.groupBy(F.floor(F.log2("n") * 8).alias("size")).count().collect()
    least, total = None, 0
    for r in sorted(by_size, key=lambda r: -r["size"]):
        total += r["count"]
        if total > most:
            break
        least = r["size"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rows = counts.where(F.floor(F.log2("n") * 8) >= int(least)).toPandas().sort_values("word", key=lambda w: w.to_numpy(np.int64).view(np.uint64))
    return rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", smoothing: float = 50.0, filter_bytes: int = 1 << 26) -> DataFrame:
    """Learns from the rows that aren't held out and scores all rows.

    Columns: the id as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(key)).alias("held_out"))
    training = rows.where("NOT held_out")
    counts = cut(word_counts(training))
    total, different = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    below = total + 0.1 * (different + 1)
    frequent = spark.sparkContext.broadcast(hot_words(counts))
    model = build(training, total, filter_bytes, frequent=frequent)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def parts(f: Filter, now: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct words, the place of each token among them, which are frequent and their counts; the texts' scores as far as their keys lie in f."""
        hot, hot_n = frequent.value
        starts = np.cumsum(lengths) - lengths
        words, word_at = np.unique(now, return_inverse=True)
        at, is_hot = known(hot, words)
        exact = np.where(is_hot, hot_n[at], 0) if len(hot) else np.zeros(len(words), np.int64)
        own = alone(words)
        singles = np.where(is_hot, MEANT[np.searchsorted(LEAST, exact, "right")], f.count(own))
        # what differs only by word is computed once for each word
        share, below_pair = smoothing * (singles + 0.1) / below, np.log10(singles + smoothing)
        # a word divides the chance of the next one, in the round of its segment or in the first; the end has no next one
        below_pair[(words == END) | np.where(is_hot, f.first > 0, ~f.holds(own))] = 0.0
        two, two_at = np.unique(pairs(before(now, lengths), now, is_hot[word_at]), return_inverse=True)
        chance = np.where(f.holds(two)[two_at], np.log10(f.count(two)[two_at] + share[word_at]), 0.0) - below_pair[word_at]
        start = alone(np.array([START]))
        return words, word_at, is_hot, exact, np.add.reduceat(chance, starts) - np.where(f.holds(start), np.log10(f.count(start) + smoothing), 0.0)

    first_round = spark.sparkContext.broadcast(model.filter(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = first_round.value
        base, done = TaskContext.get().partitionId() << 32, 0
        for batch, first, now, lengths in chunks(batches, 1):
            n = len(lengths)
            starts = np.cumsum(lengths) - lengths
            doc = np.repeat(np.arange(n), lengths)
            _, word_at, is_hot, exact, score = parts(f, now, lengths)
            hot_at = is_hot[word_at]
            part = np.where(is_hot, np.log10((exact + 0.1) / below), 0.0)[word_at]
            rare = np.flatnonzero(~hot_at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(base + done + np.arange(n)), *(batch.column(k).slice(first, n) for k in (0, 2, 3)),
                 pa.array(lengths), pa.array(np.add.reduceat(hot_at.astype(np.int64), starts)), pa.array(np.add.reduceat(part, starts)), pa.array(score),
                 arrays(as_long(now[rare]), np.bincount(doc[rare], minlength=n).astype(np.int32))],
                names=["row", "doc_id", "held_out", "text_key", "n_tokens", "hot_known", "hot_base", "score", "rare"],
            )
            done += n

    keyed = rows.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    scored = cut(keyed.select("doc_id", "text", "held_out", "text_key").mapInArrow(
        run, f"row long, doc_id {kind}, held_out boolean, text_key long, n_tokens long, hot_known long, hot_base double, score double, rare array<long>"))
    first_round.destroy()
    more = [_round(spark, model.filter(k), parts, keyed) for k in range(1, len(model.rounds))]
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(F.count("n").alias("known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(below))).alias("base"))
    scored = scored.drop("rare").join(rare, "row", "left")
    if more:  # a score depends on the text alone
        added = reduce(DataFrame.unionByName, more).groupBy("text_key").agg(F.sum("part").alias("part"))
        scored = scored.join(added, "text_key").withColumn("score", F.col("score") + F.col("part"))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("hot_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("hot_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"), "score",
    )


def _round(spark: SparkSession, held: Filter, parts: Callable, keyed: DataFrame) -> DataFrame:
    """(text_key, part): what a round adds to the score of each text."""
    model = spark.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, now, lengths in chunks(batches, 1):
            score = parts(model.value, now, lengths)[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lengths)), pa.array(score)], names=["text_key", "part"])

    found = keyed.select("text_key", "text").mapInArrow(run, "text_key long, part double")
    found = cut(found.groupBy("text_key").agg(F.max("part").alias("part")))
    model.destroy()
    return found
