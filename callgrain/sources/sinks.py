"""Append sinks, dead-letter routing and the metric matrix writer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Appends rows to a Parquet table, optionally partitioned (ledger tables use the call date)."""
    writer = df.write.mode("append")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def append_calls(calls: DataFrame, path: str) -> None:
    """Ledger append: files are cut by call date so trailing-window reads prune partitions."""
    append_table(calls.withColumn("call_date", F.to_date("started_at")), path, "call_date")


def append_spend(df: DataFrame, path: str) -> None:
    """Side ledger append; entries that are not positive are not recorded."""
    append_table(df.where(F.col("cost_usd") > 0), path)


def split_malformed(df: DataFrame, column: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows with ``parsed``, rejected rows with ``error``)."""
    typed = f"{schema}, _corrupt STRING"
    parsed = df.withColumn(
        "parsed", F.from_json(column, typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    )
    broken = F.col("parsed").isNull() | F.col("parsed._corrupt").isNotNull()
    good = parsed.where(~broken)
    bad = parsed.where(broken).select(*df.columns, F.coalesce("parsed._corrupt", F.col(column)).alias("error"))
    return good, bad


def route_batch(
    column: str, schema: str, accept: Callable[[DataFrame], None], dead_letter_path: str, attempts: int = 3
) -> Callable[[DataFrame, int], None]:
    """foreachBatch body: malformed rows, and batches that failed ``attempts`` times, go to the side store.

    ``accept`` is called again after a failure, so it must be idempotent.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        good, bad = split_malformed(batch, column, schema)
        stamp = F.current_timestamp().alias("dead_lettered_at")
        # each batch has a folder of its own, so that a batch that is run again replaces what it wrote
        bad.select("*", stamp).write.mode("overwrite").parquet(f"{dead_letter_path}/batch_id={batch_id}/kind=malformed")
        for attempt in range(1, attempts + 1):
            try:
                return accept(good)
            except Exception as e:  # noqa: BLE001
                if attempt == attempts:
                    failed = good.drop("parsed").select("*", F.lit(str(e)).alias("error"), stamp)
                    failed.write.mode("overwrite").parquet(f"{dead_letter_path}/batch_id={batch_id}/kind=failed")

    return run


def write_metrics(rows: DataFrame, path: str) -> None:
    """One JSON file of metric rows; the matrix is an aggregate, so a single small partition."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def markdown_lines(rows: DataFrame) -> DataFrame:
    """(line): Markdown table of the metric matrix, its head and then a line for each row in order of category and measure."""
    head = ["category", "measure", "live", "offline", "failures"]
    top = ["| " + " | ".join(h.capitalize() for h in head) + " |", "| " + " | ".join("---" for _ in head) + " |"]
    body = rows.select(F.lit(2).alias("place"), "category", "measure", F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(h).cast("string"), F.lit("")) for h in head]), F.lit(" |")).alias("line"))
    lines = rows.sparkSession.createDataFrame([(i, "", "", t) for i, t in enumerate(top)], body.schema)
    return lines.unionByName(body).orderBy("place", "category", "measure").select("line")


def write_markdown(rows: DataFrame, path: str) -> None:
    """The Markdown table as text; sorted output keeps its order over the files of the folder."""
    markdown_lines(rows).write.mode("overwrite").text(path)
