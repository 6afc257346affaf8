"""Semantic layer: cube queries over postings and reports over the star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cube over the canonical table.
CUBE_DIMENSIONS = ("id", "title", "company", "location", "salary", "experience", "source")
CUBE_TIME = "crawled_at"
CUBE_MEASURES = ("count",)
GRAINS = ("day", "week", "month", "quarter", "year")

# Many-to-one relations of the star: dimension → (fact key, dimension key).
RELATIONS = {
    "location": ("location_id", "location_id"),
    "work_model": ("work_model_id", "work_model_id"),
    "company": ("company_id", "company_id"),
    "category": ("job_category_id", "job_category_id"),
    "education": ("education_id", "education_id"),
    "logo": ("logo_id", "logo_id"),
    "salary_band": ("salary_band_id", "salary_band_id"),
    "date": ("job_posted_date", "date"),
}
EXPERIENCE_BANDS = ("0-1 year", "1-3 years", "3-5 years", "5-8 years", "8+ years", "Unknown")


def cube(
    rows: DataFrame, measures: Sequence[str] = CUBE_MEASURES, dimensions: Sequence[str] = (),
    time_grain: str | None = None, filters: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Measures by any dimensions, optionally by a grain of the crawl time."""
    unknown = [d for d in (*dimensions, *(filters or {})) if d not in CUBE_DIMENSIONS]
    unknown += [m for m in measures if m not in CUBE_MEASURES]
    if unknown or (time_grain and time_grain not in GRAINS):
        raise ValueError(f"not in the cube: {unknown or time_grain}")
    for name, values in (filters or {}).items():
        rows = rows.filter(F.col(name).isin(*values))
    groups = [F.col(d) for d in dimensions]
    if time_grain:
        groups.append(F.to_date(F.date_trunc(time_grain, CUBE_TIME)).alias(CUBE_TIME))
    return rows.groupBy(*groups).agg(F.count("*").alias("count"))


def measures() -> dict[str, Column]:
    """Report measures; a zero average has no number to show and becomes null."""
    average = F.avg("salary_avg_million")
    return {
        "avg_salary": F.nullif(average, F.lit(0.0)),
        "avg_salary_plain": average,
        "jobs": F.count("job_id"),
        "platforms": F.count_distinct("source_platform"),
        "companies": F.count_distinct("company_id"),
    }


def star(fact: DataFrame, **dims: DataFrame) -> DataFrame:
    """Left joins from the fact to the named dimensions.

    No side is hinted: Spark broadcasts a dimension it measures as small and
    splits skewed keys of the others while it runs.
    """
    for name, dim in dims.items():
        left, right = RELATIONS[name]
        shared = [c for c in dim.columns if c in fact.columns and c != right]
        slim = dim.drop(*shared).withColumn("_key", F.col(right))
        if right in fact.columns:
            slim = slim.drop(right)
        fact = fact.join(slim, fact[left] == slim["_key"], "left").drop("_key")
    return fact


def join_date_part(rows: DataFrame, timestamp: str, calendar: DataFrame) -> DataFrame:
    """Calendar attributes of a timestamp, by its date part."""
    return rows.join(calendar, F.to_date(rows[timestamp]) == calendar["date"], "left")


def slice_rows(rows: DataFrame, title: str | None = None, **values: Sequence[str]) -> DataFrame:
    """Report slicers: title text and value lists on any attribute."""
    if title:
        rows = rows.filter(F.lower("job_title").contains(title.lower()))
    for column, wanted in values.items():
        rows = rows.filter(F.col(column).isin(*wanted))
    return rows


def jobs_by_date_and_category(joined: DataFrame) -> DataFrame:
    return joined.groupBy("date", "job_category").agg(F.count("job_id").alias("jobs"))


def salary_pivot(joined: DataFrame) -> DataFrame:
    """Average salary, category by experience band; the bands are known, so the
    pivot needs no extra pass to find them."""
    pivoted = joined.groupBy("job_category").pivot("year_of_experiences", list(EXPERIENCE_BANDS))
    return pivoted.agg(F.round(measures()["avg_salary"], 1))


def salary_tree(joined: DataFrame) -> DataFrame:
    levels = (
        "year_of_experiences", "job_category", "job_location", "work_model_normalized",
        "education_requirement",
    )
    return joined.groupBy(*levels).agg(F.sum("salary_avg_million").alias("salary_sum"))


def jobs_by_location(joined: DataFrame) -> DataFrame:
    return joined.groupBy("job_location").agg(F.count("job_id").alias("jobs"))


def cards(fact: DataFrame) -> DataFrame:
    known = measures()
    return fact.agg(
        known["jobs"].alias("jobs"), known["platforms"].alias("platforms"),
        known["companies"].alias("companies"), F.round(known["avg_salary"], 1).alias("avg_salary"),
    )


def job_board(joined: DataFrame) -> DataFrame:
    return joined.select(
        "job_id", "job_title", "logo_path", "company_name", "job_location", "salary",
        "salary_band", "tags", "year_of_experiences", "url",
    )
