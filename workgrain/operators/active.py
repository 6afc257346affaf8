"""Active pipeline: cleaned postings and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.experience import experience_level
from ..functions.location import city_bucket
from ..functions.salary import all_digits, salary_type


def dim_jobs_clean(staged: DataFrame) -> DataFrame:
    """City bucket, salary type, salary digits and seniority beside the raw texts."""
    return staged.select(
        "id", "title", "company",
        city_bucket(F.col("location")).alias("location_clean"),
        F.col("location").alias("location_raw"),
        "raw_salary",
        salary_type(F.col("raw_salary")).alias("salary_type"),
        all_digits(F.col("raw_salary")).alias("salary_numeric_extract"),
        "raw_experience",
        experience_level(F.col("raw_experience")).alias("experience_level"),
        "source", "crawled_at",
    )


def clean_counts(clean: DataFrame) -> DataFrame:
    return clean.groupBy("location_clean", "experience_level").agg(F.count("*").alias("jobs"))
