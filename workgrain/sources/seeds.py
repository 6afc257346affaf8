"""Seed tables: title pattern → category, location pattern → city and region.

The shipped tables are CSV files beside this module; a first line that starts with # is a comment.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DATA = Path(__file__).parent / "data"
SCHEMAS = {
    "job_category_mapping": "pattern string, target_job_category string",
    "vn_city_mapping": "pattern string, city_code string, city_en string, region string",
}


def read_rows(name: str) -> list[tuple[str, ...]]:
    """Rows of a shipped seed."""
    with (DATA / f"{name}.csv").open(encoding="utf-8", newline="") as lines:
        rows = csv.reader(line for line in lines if not line.startswith("#"))
        next(rows)
        return [tuple(row) for row in rows if row]


CATEGORY_PATTERNS = read_rows("job_category_mapping")
CITY_PATTERNS = read_rows("vn_city_mapping")


def load_seed(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """A shipped seed, or a CSV file with a header that replaces it."""
    if path is not None:
        return spark.read.schema(SCHEMAS[name]).csv(path, header=True, comment="#")
    return spark.createDataFrame(read_rows(name), SCHEMAS[name])


def seed_patterns(seed: DataFrame, most: int = 10_000) -> list[tuple[str, ...]] | DataFrame:
    """What the pattern joins take: the rows of a small seed, which become literals, or a larger table as it is, which is joined."""
    known = seed.filter("pattern IS NOT NULL")
    rows = [tuple(r) for r in known.limit(most + 1).collect()]
    return known if len(rows) > most else rows
