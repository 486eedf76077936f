"""Cutting lineage where several later steps read the same expensive table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, one in the session's warehouse, if all machines can see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    one_machine = spark.sparkContext.master.split("[")[0] == "local"
    if not one_machine and (":" not in warehouse or warehouse.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return warehouse.rstrip("/") + "/_work"


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; the files survive lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def release(*settled: DataFrame) -> None:
    """Deletes the files of settled tables that no later step reads, and lets Spark delete the shuffles of the steps that made them.

    Spark does the latter when the driver collects garbage, which it may never do while a query runs. Tables that were not settled stay.
    """
    for df in settled:
        plan, jvm = df._jdf.queryExecution().analyzed(), df.sparkSession._jvm
        if plan.getClass().getSimpleName() != "LogicalRDD" or (file := plan.rdd().getCheckpointFile()).isEmpty():
            continue
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if settled:
        settled[0].sparkSession._jvm.System.gc()
