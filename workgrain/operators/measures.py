"""Grouped measures over the fact table, built to shuffle little.

Distinct counts of urls under many conditions would make Spark copy every row
once per condition. Here rows first collapse to one per (group, url) with one
flag per condition, which then simply add up; only the plain distinct columns
go through ``count_distinct``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import numbered

SALARY = "salary_avg_million"


def url_flags() -> dict[str, Column]:
    """Conditions the reports count distinct urls under."""
    model = F.col("work_model_normalized")
    return {
        "any": F.lit(True),
        "posted": F.col("posted_to_discord"),
        "remote": model == "Remote",
        "hybrid": model == "Hybrid",
        "onsite": model == "On-Site",
        "fulltime": F.col("work_arrangement_normalized") == "Full-time",
        "bachelor": F.col("education_requirement") == "Bachelor",
        "salaried": F.col(SALARY).isNotNull(),
    }


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def grouped(
    fact: DataFrame,
    keys: Sequence[str],
    flags: Sequence[str] = (),
    distinct: Sequence[str] = (),
    sets: Sequence[str] = (),
) -> DataFrame:
    """Per group: rows, dates, salary measures, ``n_<flag>`` and ``d_<column>`` counts.

    ``sets`` adds the sorted values of columns with few distinct values.
    """
    tests = url_flags()
    per_url = fact.groupBy(*keys, "url").agg(
        F.count("*").alias("rows"),
        F.sum(SALARY).alias("salary_sum"),
        F.count(SALARY).alias("salary_rows"),
        F.min("salary_min_million").alias("salary_low"),
        F.max("salary_max_million").alias("salary_high"),
        F.min("job_posted_date").alias("first_date"),
        F.max("job_posted_date").alias("last_date"),
        *[F.collect_set(c).alias(f"s_{c}") for c in sets],
        *[
            F.max((F.coalesce(tests[f], F.lit(False)) & F.col("url").isNotNull()).cast("int")).alias(f)
            for f in flags
        ],
    )
    measures = per_url.groupBy(*keys).agg(
        F.sum("rows").alias("rows"),
        F.round(F.sum("salary_sum") / F.sum("salary_rows"), 1).alias("avg_salary"),
        F.min("salary_low").alias("salary_low"),
        F.max("salary_high").alias("salary_high"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        *[
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(f"s_{c}")))).alias(f"s_{c}")
            for c in sets
        ],
        *[F.sum(f).alias(f"n_{f}") for f in flags],
    )
    if not distinct:
        return measures
    counts = fact.groupBy(*keys).agg(*[F.count_distinct(c).alias(f"d_{c}") for c in distinct])
    joined = measures.join(counts, same_keys(measures, counts, keys))
    return joined.drop(*[counts[k] for k in keys])


def share(part: Column, whole: Column) -> Column:
    return F.round(part * F.lit(100.0) / whole, 2)


def with_total(groups: DataFrame, total: DataFrame) -> DataFrame:
    """Attaches a one-row, one-column total to every group, as a scalar subquery."""
    return groups.withColumn("total", total.scalar())


def global_rank(rows: DataFrame, measure: str, ident: str, rank: str) -> DataFrame:
    """``row_number`` over all rows by falling measure, then id; rows without an id come last among equal measures."""
    return numbered(rows, [F.col(measure).desc_nulls_last(), F.col(ident).asc_nulls_last()], rank)
