"""Dashboard statistics over the canonical table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import source_name
from ..functions.location import dashboard_city
from ..functions.salary import DASHBOARD_RATE, vnd_millions_mean
from ..functions.text import trim_blanks

# Names shown here, salary labels, and how many rows two lists hold.
SHOWN_SOURCES = {"itviec": "ITViec", "linkedin": "LinkedIn", "topcv": "TopCV"}
SALARY_LABELS = ("< 10 Triệu", "10 - 20 Triệu", "20 - 40 Triệu", "> 40 Triệu")
TOP_COMPANIES = 10
TREND_DAYS = 14


def totals(rows: DataFrame) -> DataFrame:
    company = F.nullif(trim_blanks(F.col("company")), F.lit(""))
    return rows.agg(
        F.count("*").alias("total_jobs"), F.count_distinct(company).alias("total_companies")
    )


def jobs_by_source(rows: DataFrame) -> DataFrame:
    known = rows.filter(F.col("source").isNotNull())
    counts = known.groupBy("source").agg(F.count("*").alias("value"))
    named = counts.select(source_name(F.col("source"), SHOWN_SOURCES).alias("name"), "value")
    return named.orderBy(F.desc("value"), "name")


def jobs_by_city(rows: DataFrame) -> DataFrame:
    known = rows.filter(F.col("location").isNotNull())
    counts = known.groupBy(dashboard_city(F.col("location")).alias("name")).agg(
        F.count("*").alias("value")
    )
    return counts.orderBy(F.desc("value"), "name")


def top_companies(rows: DataFrame, limit: int = TOP_COMPANIES) -> DataFrame:
    known = rows.filter(F.col("company").isNotNull())
    counts = known.groupBy(F.col("company").alias("name")).agg(F.count("*").alias("jobs"))
    return counts.orderBy(F.desc("jobs"), "name").limit(limit)


def daily_trend(rows: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    known = rows.filter(F.col("crawled_at").isNotNull())
    counts = known.groupBy(F.to_date("crawled_at").alias("day")).agg(F.count("*").alias("jobs"))
    newest = counts.orderBy(F.desc("day")).limit(days)
    return newest.orderBy("day").select("day", F.date_format("day", "dd/MM").alias("date"), "jobs")


def salary_histogram(rows: DataFrame, rate: int = DASHBOARD_RATE) -> DataFrame:
    """Postings per salary range, over all rows; empty ranges count zero."""
    salary = F.col("salary")
    given = rows.filter(salary.isNotNull() & ~salary.isin("", "Thoả thuận", "Thỏa thuận"))
    mean = given.select(vnd_millions_mean(salary, rate).alias("mean"))
    tests = (
        F.col("mean") < 10,
        (F.col("mean") >= 10) & (F.col("mean") <= 20),
        (F.col("mean") > 20) & (F.col("mean") <= 40),
        F.col("mean") > 40,
    )
    counts = mean.agg(*[F.count_if(test).alias(f"r{i}") for i, test in enumerate(tests)])
    pairs = ", ".join(f"'{label}', r{i}" for i, label in enumerate(SALARY_LABELS))
    return counts.selectExpr(f"stack({len(SALARY_LABELS)}, {pairs}) AS (name, jobs)")
