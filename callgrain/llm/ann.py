"""Nearest neighbours by cosine with multi-index hashing of learned binary codes.

A rotation is learned on a sample of at most ``SAMPLE`` rows, those of least hash: directions of greatest variance, then
turned until their signs lose least (iterative quantisation). A code is the signs of a rotated unit vector, cut into
substrings of 8 bits, each with a table of its own. Two codes within a radius agree in one substring up to the radius
divided by the number of substrings, so probing the tables of all substrings within that distance finds every code inside
the radius. What is found is checked on full codes and ranked on the original vectors in double precision. The radius is
that within which the sample holds ``share`` of its own nearest neighbours; a larger table has nearer ones, so the sample
errs on the safe side.

All rows are indexed, in blocks; each block of queries goes to each block of the index, and only the best of both leave
the task. Queries that find fewer than ``k`` rows are asked again over all codes.

Vectors that are null, zero, of another length than the most frequent one, or hold null or non-finite components take no
part, nor do rows with a null id. Ties go to the smaller id. Rows with a query's id are the query's own and are never its
neighbours; an id that occurs on several rows is found once, by its best row, and asked once, by any one of its rows. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from callgrain.llm.common import cut

SAMPLE, PIECE = 20_000, 8
BLOCK, QUERIES = 8192, 512
_NEAR = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)


def learn(x: np.ndarray, rounds: int = 40, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation of unit vectors; the number of bits is the greatest multiple of PIECE in their length."""
    bits = max(PIECE, x.shape[1] // PIECE * PIECE)
    mean = x.mean(0)
    z = x - mean
    _, directions = np.linalg.eigh(z.T @ z)
    main = directions[:, ::-1][:, :bits]
    if main.shape[1] < bits:  # very short vectors: more bits than directions
        main = np.concatenate([main, np.random.default_rng(seed + 1).normal(size=(x.shape[1], bits - main.shape[1]))], 1)
    v = z @ main
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.sign(v @ turn).T @ v)
        turn = (left @ right).T
    return mean, main @ turn


def codes(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.packbits((x - model[0]) @ model[1] > 0, axis=1)


def calibrate(x: np.ndarray, model: tuple[np.ndarray, np.ndarray], k: int, share: float, asked: int = 500) -> int:
    """The radius that holds ``share`` of the k nearest of the first ``asked`` vectors."""
    c, q = codes(x, model), min(asked, len(x))
    near = x[:q] @ x.T
    near[np.arange(q), np.arange(q)] = -9
    best = np.argsort(-near, axis=1)[:, : min(k, max(1, len(x) - 1))]
    far = np.bitwise_count(c[:q, None] ^ c[best]).sum(2)
    return int(np.quantile(far, share, method="higher"))


class Tables:
    """One table for each substring of a block of codes: the rows of each value."""

    def __init__(self, code: np.ndarray) -> None:
        self.code = code
        self.rows = [np.argsort(code[:, s], kind="stable") for s in range(code.shape[1])]
        self.starts = [np.searchsorted(code[r, s], np.arange(257)) for s, r in enumerate(self.rows)]

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """All rows within the radius, in order."""
        found = np.zeros(len(self.code), bool)
        for s, (rows, starts) in enumerate(zip(self.rows, self.starts)):
            for value in np.flatnonzero(_NEAR[query[s]] <= radius // self.code.shape[1]):
                found[rows[starts[value] : starts[value + 1]]] = True
        hit = np.flatnonzero(found)
        return hit[np.bitwise_count(self.code[hit] ^ query).sum(1) <= radius]


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    length = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (length["size"] if length else 0))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _search(index: DataFrame, queries: DataFrame, model: tuple, radius: int, k: int, blocks: int, count: int) -> DataFrame:
    """(query_id, vec_id, score): the k best of each block for each query."""

    def answer(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, q: np.ndarray, tables: Tables) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        code = codes(_unit(q), model)
        norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        for i, own in enumerate(asked):
            hit = tables.within(code[i], radius)
            hit = hit[ids[hit] != own]
            if not len(hit):
                continue
            # products are summed row by row, so that equal vectors have equal scores
            score = (x[hit] * q[i]).sum(1) / (norm[hit] * q_norm[i])
            order = np.lexsort((ids[hit], -score))
            _, first = np.unique(ids[hit][order], return_index=True)
            best = order[np.sort(first)[:k]]
            yield own, ids[hit][best], score[best]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, built = None, [], None
        for batch in batches:
            block, is_query = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (is_query[1:] != is_query[:-1])) + 1), batch.num_rows]
            for first, last in zip(turns, turns[1:]):
                if first == last:
                    continue
                if block[first] != at:
                    at, parts, built = block[first], [], None
                rows = batch.slice(first, last - first)
                if not is_query[first]:
                    ids = rows.column(2).flatten().to_numpy()
                    parts.append((ids, rows.column(3).flatten().to_numpy().reshape(len(ids), -1)))
                    continue
                if built is None and parts:
                    ids, x = (np.concatenate(c) for c in zip(*parts))
                    built = ids, x, Tables(codes(_unit(x), model))
                for k_row in range(rows.num_rows if built else 0):
                    asked = rows.column(2)[k_row].values.to_numpy()
                    q = rows.column(3)[k_row].values.to_numpy().reshape(len(asked), -1)
                    found = [*answer(built[0], built[1], asked, q, built[2])]
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])), pa.array(np.concatenate([f[1] for f in found])),
                             pa.array(np.concatenate([f[2] for f in found]))], names=["query_id", "vec_id", "score"])

    here = index.select(F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("is_query"), F.array("vec_id").alias("ids"), "v")
    runs = F.pmod(F.xxhash64("vec_id"), F.lit(-(-count // QUERIES)))
    asked = queries.groupBy(runs.alias("_run")).agg(F.collect_list(F.struct("vec_id", "v")).alias("q"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("is_query"), F.col("q.vec_id").alias("ids"), F.flatten("q.v").alias("v"))
    rows = here.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "is_query")
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def search(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, share: float = 0.98) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of ``index`` for each row of ``queries``."""
    rows, asked = usable(index, key, vector), usable(queries, key, vector).groupBy("vec_id").agg(F.min("v").alias("v"))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    total, count = rows.count(), asked.count()
    if not total or not count:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _unit(np.stack(sample["v"].to_numpy()).astype(float))
    model = learn(x)
    radius = calibrate(x, model, k, share)
    blocks = -(-total // BLOCK)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    near = cut(best(_search(rows, asked, model, radius, k, blocks, count)))
    full = near.groupBy("query_id").count().where(F.col("count") >= k)
    short = asked.join(full, F.col("vec_id") == F.col("query_id"), "left_anti")
    if short.isEmpty():
        return near
    again = best(_search(rows, short, model, 8 * len(codes(x[:1], model)[0]), k, blocks, count))
    return near.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
