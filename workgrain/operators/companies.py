"""Company directory, slugs, facets and salary ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.salary import parse_salary
from ..functions.text import slug, trim_blanks
from .search import PAGE_SIZE

FACETS = 8
INDEXABLE_JOBS = 2


def directory(rows: DataFrame) -> DataFrame:
    """One company per slug, the one with most postings; ties go to the first name."""
    named = rows.filter(trim_blanks(F.col("company")) != "")
    counts = named.groupBy("company").agg(
        F.count("*").alias("job_count"), F.max("crawled_at").alias("latest")
    )
    slugged = counts.withColumn("slug", slug(F.col("company"))).filter(F.col("slug") != "")
    best = Window.partitionBy("slug").orderBy(F.desc("job_count"), "company")
    picked = slugged.withColumn("_place", F.row_number().over(best)).filter("_place = 1")
    return picked.select("company", "slug", "job_count", "latest")


def search_companies(entries: DataFrame, term: str) -> DataFrame:
    word = term.strip().lower()
    return entries.filter(F.lower("company").contains(word)) if word else entries


def directory_page(entries: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    return entries.orderBy(F.desc("job_count"), "company").offset((page - 1) * size).limit(size)


def indexable(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("job_count") >= INDEXABLE_JOBS)


def company_by_slug(entries: DataFrame, rows: DataFrame, wanted: str) -> DataFrame:
    """Postings of the company behind a slug, newest first."""
    company = entries.filter(F.col("slug") == wanted).select("company")
    return rows.join(company, "company", "left_semi").orderBy(
        F.col("crawled_at").desc_nulls_first(), "id"
    )


def facets(rows: DataFrame, value: str, k: int = FACETS) -> DataFrame:
    """The k most frequent values of a column per company, one row each."""
    known = rows.filter(F.nullif(F.col(value), F.lit("")).isNotNull() & F.col("company").isNotNull())
    counts = known.groupBy("company", F.col(value).alias("value")).agg(F.count("*").alias("count"))
    order = Window.partitionBy("company").orderBy(F.desc("count"), "value")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def facet_lists(rows: DataFrame, value: str, k: int = FACETS) -> DataFrame:
    """The same facets as one ordered array of (value, count) per company."""
    entry = F.struct("place", "value", "count")
    listed = facets(rows, value, k).groupBy("company").agg(
        F.array_sort(F.collect_list(entry)).alias("entries")
    )
    plain = F.transform("entries", lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))
    return listed.select("company", plain.alias("facets"))


def salary_ranges(rows: DataFrame) -> DataFrame:
    """Lowest and highest VND amount per company in millions, as text."""
    pay = rows.filter(F.col("company").isNotNull()).select(
        "company", parse_salary(F.col("salary")).alias("pay")
    )
    # A filter on the currency would parse every text a second time below the projection.
    vnd = F.col("pay.currency") == "VND"
    bounds = pay.groupBy("company").agg(
        F.min(F.when(vnd, F.least("pay.min", "pay.max", "pay.value"))).alias("low"),
        F.max(F.when(vnd, F.greatest("pay.min", "pay.max", "pay.value"))).alias("high"),
    ).filter(F.col("low").isNotNull())

    def shown(name: str) -> F.Column:
        millions = F.col(name) / 1_000_000
        whole = millions == F.floor(millions)
        return F.when(whole, F.floor(millions).cast("string")).otherwise(
            F.format_string("%.1f", F.round(millions, 1))
        )

    text = F.when(F.col("low") == F.col("high"), F.concat(shown("low"), F.lit(" triệu"))).otherwise(
        F.concat(shown("low"), F.lit(" – "), shown("high"), F.lit(" triệu"))
    )
    return bounds.select("company", text.alias("salary_range"))


def company_detail(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """Directory entries with their facets and salary range; companies without
    a value keep null facets."""
    detail = entries.select("company", "slug", "job_count")
    parts = [
        facet_lists(rows, "location").withColumnRenamed("facets", "locations"),
        salary_ranges(rows),
    ]
    for part in parts:
        detail = detail.join(part, "company", "left")
    return detail
