"""Run ledger: classification and the two audit summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import ledger_layer, ledger_source, ledger_type

PIPELINE = "master_job_elt"
COUNTERS = ("rows_processed", "rows_inserted", "rows_scraped", "discord_posts_sent", "discord_posts_failed")


def classify(rows: DataFrame) -> DataFrame:
    """Adds task type, data source and layer from the task id."""
    task = F.col("task_id")
    return rows.withColumns({
        "task_type": ledger_type(task), "data_source": ledger_source(task), "layer": ledger_layer(task),
    })


def ledger_rows(rows: DataFrame) -> DataFrame:
    """Classified rows with the columns the summaries read; missing ones get defaults."""
    rows = classify(rows)
    defaults = {
        "task_name": F.col("task_id"),
        "dag_status": F.col("task_status"),
        "task_group": F.lit(None).cast("string"),
        "duration_seconds": F.col("task_duration_seconds"),
        "start_date": F.col("execution_date"),
        "end_date": F.col("execution_date"),
        **{c: F.lit(0).cast("bigint") for c in COUNTERS},
    }
    return rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})


def _with_status(status: str) -> F.Column:
    return F.count_if(F.col("task_status") == status)


def job_elt_summary(ledger: DataFrame) -> DataFrame:
    runs = ledger.filter(F.col("dag_id") == PIPELINE)
    return runs.groupBy(
        "task_name", F.to_date("execution_date").alias("execution_day"), "dag_status"
    ).agg(
        F.count_distinct("dag_run_id").alias("total_dag_runs"),
        F.count_distinct("task_id").alias("total_tasks"),
        _with_status("success").alias("successful_tasks"),
        _with_status("failed").alias("failed_tasks"),
        *[F.sum(c).alias(f"total_{c}") for c in COUNTERS],
        F.avg("duration_seconds").alias("avg_dag_duration_seconds"),
        F.min("start_date").alias("first_start_time"),
        F.max("end_date").alias("last_end_time"),
    ).orderBy(F.desc("execution_day"), "dag_status")


def task_performance(ledger: DataFrame) -> DataFrame:
    runs = ledger.filter(F.col("dag_id") == PIPELINE)
    duration = F.col("task_duration_seconds")
    return runs.groupBy("task_name", "task_group", "data_source", "layer").agg(
        F.count("*").alias("execution_count"),
        _with_status("success").alias("success_count"),
        _with_status("failed").alias("failure_count"),
        F.round(_with_status("success") * F.lit(100.0) / F.count("*"), 2).alias("success_rate_pct"),
        F.avg(duration).alias("avg_duration_seconds"),
        F.min(duration).alias("min_duration_seconds"),
        F.max(duration).alias("max_duration_seconds"),
        F.avg("rows_processed").alias("avg_rows_processed"),
        F.max("execution_date").alias("last_execution_date"),
    ).orderBy(F.desc("execution_count"))
