"""Exactly-once ingest: the first request of a key is accepted, replays are answered with it, however late they come."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def first_wins(folder: str, key: Sequence[str], at: str = "ts", tie: str = "id", buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """foreachBatch body that appends to the table of accepted requests those whose key it doesn't hold.

    The table itself is the memory, so nothing is kept in the state of the stream. It is cut by batch, and a batch that
    is run again replaces what it wrote and doesn't look at it; and by a hash of the key, so that only the buckets that the batch
    has keys in are read. Within a batch the earliest request of a key is the first, then that of the smallest ``tie``.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        row = F.struct(*batch.columns)
        first = batch.groupBy(*key).agg(F.min_by(row, F.struct(at, tie)).alias("row")).select("row.*").withColumn("bucket", bucket)
        try:
            known = spark.read.parquet(folder).where(F.col("batch") < batch_id)
        except Exception as missing:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(missing) and "UNABLE_TO_INFER_SCHEMA" not in str(missing):
                raise
            known = None
        if known is not None:
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            held = known.where(F.col("bucket").isin(touched)).select("bucket", *[F.col(k).alias(f"__{k}") for k in key])
            same = first["bucket"] == held["bucket"]
            for k in key:
                same = same & first[k].eqNullSafe(held[f"__{k}"])
            first = first.join(held, same, "left_anti")
        first.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={batch_id}")

    return run


def accept_once(requests: DataFrame, folder: str, key: Sequence[str], at: str = "ts", tie: str = "id") -> DataStreamWriter:
    return requests.writeStream.foreachBatch(first_wins(folder, key, at, tie))


def answered(requests: DataFrame, accepted: DataFrame, key: Sequence[str], tie: str = "id") -> DataFrame:
    """Every request with the one that answers it."""
    names = accepted.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(tie).alias("answered_by"))
    same = F.lit(True)
    for k in key:
        same = same & requests[k].eqNullSafe(names[f"__{k}"])
    return requests.join(names, same).drop(*[f"__{k}" for k in key])


def on_time_once(events: DataFrame, key: Sequence[str], at: str, delay: str) -> DataFrame:
    """Rows that aren't behind the watermark when they come, each key once."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([*key])
