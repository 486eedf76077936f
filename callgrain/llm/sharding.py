"""Weighted rendezvous hashing of stable record keys over shards.

Each shard bids for a key with -ln(u) / weight, where u is a hash of key and shard in (0, 1); the lowest bid has the key.
A further shard wins only the keys for which its own bid is lowest, so all others stay where they are. Bids are column
expressions; nothing is collected and no table of keys is kept.

A null key is a key like any other. Equal keys always share a shard; equal rows are told apart only by their slot. A null or
empty text has the size 1 and the checksum 0; texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit(key: Column, shard: int, seed: str) -> Column:
    """A number in (0, 1) from key and shard: 48 bits of an MD5 sum, which any engine can compute."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def shard_of(key: Column, weights: Mapping[int, float], seed: str = "shard") -> Column:
    """The shard of a key; ``weights`` maps shards to their share. Equal bids go to the smaller shard."""
    bids = [F.struct((-F.log(unit(key, s, seed)) / F.lit(float(w))).alias("bid"), F.lit(s).alias("shard")) for s, w in sorted(weights.items()) if w > 0]
    if not bids:
        raise ValueError("no shard has a weight")
    return F.array_min(F.array(*bids))["shard"]


def with_slots(df: DataFrame, shard: str, order: str, slot: str = "slot", block: int = 65_536) -> DataFrame:
    """Numbers the rows of each shard from 0 in the order of an integer column.

    Rows are ranked inside blocks of ``block`` consecutive keys, and the counts of the blocks before are added, so that no
    task sorts a whole shard.
    """
    parted = df.withColumn("_block", F.coalesce(F.floor(F.col(order) / block), F.lit(-(2**62))))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = parted.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n")).select(shard, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(order)) - 1
    return parted.withColumn("_rank", inside).join(starts, [shard, "_block"]).withColumn(slot, (F.col("_start") + F.col("_rank")).cast("long")).drop("_block", "_rank", "_start")


def assign(df: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and size of each row, and its shard under the weights ``grown``. Text isn't moved."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = df.select(
        F.col(key), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), grown).alias("grown_shard"),
    )
    return with_slots(rows, "shard", key)


def write_shards(df: DataFrame, folder: str, weights: Mapping[int, float], key: str = "doc_id", files: int = 8) -> None:
    """Writes whole rows below ``folder``/shard=n; a shard is written by ``files`` tasks."""
    placed = df.withColumn("shard", shard_of(F.col(key), weights))
    placed.repartition(len(weights) * files, "shard", F.pmod(F.xxhash64(key), F.lit(files))).write.partitionBy("shard").mode("overwrite").parquet(folder)
