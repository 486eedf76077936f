"""Event streams from files and running a bounded stream to completion."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from callgrain.sources.settle import shared_root

WATERMARK = "10 minutes"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, directory: str, schema: str, glob: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a directory as a stream with a fixed schema."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(directory)


def for_tenant(stream: DataFrame, owner) -> DataFrame:
    """Events one tenant may see: its own and the ownerless ones."""
    return stream.where(F.col("owner_id").isNull() | (F.col("owner_id") == F.lit(owner)))


def work_dir(spark: SparkSession, name: str) -> str:
    """New folder for checkpoints and results, inside the folder that driver and executors share."""
    return f"{shared_root(spark)}/callgrain-{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Processes everything available and returns the written result as a table."""
    spark = stream.sparkSession
    root = work_dir(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_in_steps(arrivals: DataFrame, step: str, steps: int, name: str, write: Callable[[DataFrame, str], DataStreamWriter]) -> str:
    """Feeds a stream in ``steps`` runs: the rows of the next step are appended to a folder, then the query works off what is new and stops.

    This is how a scheduled incremental job runs: one checkpoint, a batch for each run, state and watermark kept between them.
    ``write`` makes the writer from the stream and the folder for results, which is returned.
    """
    spark = arrivals.sparkSession
    root = work_dir(spark, name)
    rows = arrivals.drop(step)
    for k in range(steps):
        arrivals.where(F.col(step) == k).drop(step).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        write(stream, f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return f"{root}/out"
