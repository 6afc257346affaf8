"""Crawl batches as JSON and flat exports as CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_batch(batch: DataFrame, path: str) -> None:
    """One JSON object per line, so the files split."""
    batch.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_batch(spark: SparkSession, path: str, schema: str, array_files: bool = False) -> DataFrame:
    """``array_files`` reads files that hold a single JSON array."""
    return spark.read.schema(schema).option("multiLine", str(array_files).lower()).json(path)


def export_csv(rows: DataFrame, columns: Sequence[str], path: str) -> None:
    written = rows.select(*columns).write.mode("overwrite").option("escape", "\"")
    keep = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    written.options(**keep).csv(path, header=True)
