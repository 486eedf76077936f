"""Ledger tables with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CALLS = """id STRING, started_at TIMESTAMP, ended_at TIMESTAMP, updated_at TIMESTAMP, status STRING, input_source STRING, sample_id STRING,
 injected_fault STRING, label_source STRING, stt_provider_used STRING, stt_failover_occurred BOOLEAN, predicted_category STRING,
 classifier_confidence DOUBLE, ab_run_id STRING, ab_side STRING, redacted_transcript STRING, total_cost_usd DECIMAL(18,9),
 idempotency_key STRING, owner_id STRING, analysis STRING"""
STAGES = """id STRING, call_id STRING, stage STRING, provider STRING, started_at TIMESTAMP, ended_at TIMESTAMP, duration_ms INT, status STRING,
 raw_meta STRING, cost_usd DECIMAL(18,9)"""
REPORTS = "report_id STRING, call_id STRING, report_text STRING, generated_at TIMESTAMP"
AB_RUNS = "ab_run_id STRING, config_a STRING, config_b STRING, fault_type STRING, created_at TIMESTAMP, owner_id STRING, sample_id STRING, iterations INT, fault_params STRING"
SLA_CONFIG = "owner_id STRING, max_failure_rate_pct DOUBLE, window_minutes INT"
SPEND = "at TIMESTAMP, owner_id STRING, kind STRING, cost_usd DECIMAL(12,6)"


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet table with a fixed schema; columns older files lack read as null."""
    return spark.read.schema(schema).parquet(path)


def load_calls(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, f"{directory}/calls", CALLS).withColumn("total_cost_usd", _double("total_cost_usd"))


def load_stages(spark: SparkSession, directory: str) -> DataFrame:
    return load(spark, f"{directory}/call_stages", STAGES).withColumn("cost_usd", _double("cost_usd"))


def _double(name: str):
    from pyspark.sql import functions as F

    return F.col(name).cast("double")
