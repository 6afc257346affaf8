"""Warehouse layers: bronze projections, per-source bases, the fact table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.experience import (
    education_level, experience_band, experience_phrase, experience_rank, experience_years,
)
from ..functions.location import normal_location, work_arrangement, work_model
from ..functions.salary import max_salary, mid_salary, min_salary, salary_band
from ..functions.text import lower_trim, surrogate_key, title_case, trim_blanks, upper_trim
from ..sources.seeds import CATEGORY_PATTERNS, CITY_PATTERNS
from .matching import explode_patterns, join_patterns

OTHERS = "Others"
ELSEWHERE = "nơi khác"


def _bronze(staging: DataFrame) -> dict[str, Column]:
    shared = {
        "title": title_case(F.col("title")),
        "company": upper_trim(F.col("company")),
        "logo_url": trim_blanks(F.col("logo_url")),
        "url": trim_blanks(F.col("url")),
        "job_category": F.col("job_category"),
        "working_location": title_case(F.col("working_location")),
        "work_model": title_case(F.col("work_model")),
        "descriptions": lower_trim(F.col("descriptions")),
        "posted_to_discord": F.col("posted_to_discord"),
        "created_at": F.col("created_at"),
    }
    if "id" in staging.columns:
        shared = {"id": F.col("id"), **shared}
    return shared


def _project(staging: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return staging.select(*[c.alias(name) for name, c in columns.items()])


def bronze_topcv(staging: DataFrame) -> DataFrame:
    return _project(staging, {
        **_bronze(staging),
        "salary": F.replace(title_case(F.col("salary")), F.lit(","), F.lit("")),
        "requirements": lower_trim(F.col("requirements")),
        "experiences": lower_trim(F.col("experiences")),
        "level_of_education": title_case(F.col("level_of_education")),
    })


def bronze_itviec(staging: DataFrame) -> DataFrame:
    return _project(staging, {
        **_bronze(staging),
        "tags": title_case(F.col("tags")),
        "requirements_and_experiences": lower_trim(F.col("requirements_and_experiences")),
    })


def ingest_topcv(bronze: DataFrame) -> DataFrame:
    return bronze.withColumns({
        "least_level_of_education": education_level(F.col("level_of_education")),
        "exp": experience_phrase(F.col("experiences")),
    })


def ingest_itviec(bronze: DataFrame) -> DataFrame:
    return bronze.withColumns({
        "least_level_of_education": education_level(F.col("requirements_and_experiences")),
        "exp": experience_phrase(F.col("requirements_and_experiences")),
    })


def jobs_unified(topcv: DataFrame, itviec: DataFrame) -> DataFrame:
    """Both enriched sources in one layout; the source without salaries gives nulls."""
    def layout(rows: DataFrame, source: str) -> DataFrame:
        salary = F.col("salary") if "salary" in rows.columns else F.lit(None).cast("string")
        return rows.select(
            F.lit(source).alias("source"), "url", "title",
            F.col("company").alias("company_name"), "working_location", "work_model",
            salary.alias("salary"), "least_level_of_education",
            F.col("exp").alias("experience_required"), "created_at",
        )

    return layout(itviec, "itviec").unionByName(layout(topcv, "topcv"))


def categorize(
    rows: DataFrame, patterns: Sequence[tuple[str, str]] | DataFrame = CATEGORY_PATTERNS
) -> DataFrame:
    """Adds ``job_category``; a title that hits several patterns gives several rows. A large pattern table is joined."""
    lowered = rows.withColumn("_title", F.lower("title")).drop("job_category")
    if isinstance(patterns, DataFrame):
        words = F.regexp_replace("pattern", r"^\(\?i\)", "(?iU)")
        table = patterns.select(words.alias("_pattern"), F.col(patterns.columns[1]).alias("job_category"))
        hits = join_patterns(lowered, "_title", table, "_pattern").drop("_title", "_pattern")
    else:
        unicode_words = [(p.replace("(?i)", "(?iU)", 1), value) for p, value in patterns]
        hits = explode_patterns(lowered, "_title", unicode_words, "job_category").drop("_title")
    return hits.withColumn("job_category", F.coalesce("job_category", F.lit(OTHERS)))


def map_city(rows: DataFrame, patterns: Sequence[tuple[str, ...]] | DataFrame = CITY_PATTERNS) -> DataFrame:
    """Adds ``job_location``, the English city name; null when no pattern is found.

    The patterns are matched in the projection itself: rows stay where they are, whatever place is the commonest.
    A large pattern table is joined instead.
    """
    if isinstance(patterns, DataFrame):
        table = patterns.select(F.col("pattern").alias("_pattern"), F.col(patterns.columns[2]).alias("job_location"))
        return join_patterns(rows, "working_location", table, "_pattern").drop("_pattern")
    names = [(row[0], row[2]) for row in patterns]
    return explode_patterns(rows, "working_location", names, "job_location")


_BASE = (
    "source_platform", "url", "logo_url", "title", "company", "working_location",
    "work_arrangement", "work_model", "salary", "job_category", "salary_min_million",
    "salary_max_million", "education_requirement", "descriptions", "requirements",
    "year_of_experiences", "tags", "posted_to_discord", "job_posted_date",
    "job_posted_timestamp",
)


Patterns = Sequence[tuple[str, ...]] | DataFrame


def _base(bronze: DataFrame, columns: dict[str, Column], categories: Patterns) -> DataFrame:
    """Common columns, with the category patterns matched after the projection."""
    common = {
        "working_location": normal_location(F.col("working_location")),
        "job_posted_date": F.to_date("created_at"),
        "job_posted_timestamp": F.col("created_at"),
    }
    return categorize(bronze.withColumns({**common, **columns}), categories).select(*_BASE)


def topcv_base(bronze: DataFrame, categories: Patterns = CATEGORY_PATTERNS) -> DataFrame:
    """The ``*_million`` columns hold whole VND; their names are kept."""
    return _base(bronze, {
        "source_platform": F.lit("topcv"),
        "work_arrangement": F.col("work_model"),
        "work_model": F.lit("On-Site"),
        "salary_min_million": min_salary(F.col("salary")),
        "salary_max_million": max_salary(F.col("salary")),
        "education_requirement": education_level(F.col("level_of_education")),
        "year_of_experiences": experience_phrase(F.col("experiences")),
        "tags": F.col("job_category"),
    }, categories)


def itviec_base(bronze: DataFrame, categories: Patterns = CATEGORY_PATTERNS) -> DataFrame:
    return _base(bronze, {
        "source_platform": F.lit("itviec"),
        "work_arrangement": F.lit("Full-time"),
        "salary": F.lit(None).cast("string"),
        "salary_min_million": F.lit(None).cast("bigint"),
        "salary_max_million": F.lit(None).cast("bigint"),
        "education_requirement": education_level(F.col("requirements_and_experiences")),
        "requirements": F.col("requirements_and_experiences"),
        "year_of_experiences": experience_phrase(F.col("requirements_and_experiences")),
    }, categories)


def explode_locations(base: DataFrame) -> DataFrame:
    """One row per listed place; rows without a location drop out."""
    parts = base.withColumn("working_location", F.explode(F.split("working_location", "-")))
    kept = parts.filter(~F.col("working_location").contains(ELSEWHERE))
    return kept.withColumn("working_location", trim_blanks(F.col("working_location")))


LOGO_SALTS = 1024


def join_logos(rows: DataFrame, logos: DataFrame) -> DataFrame:
    """Adds ``logo_id`` of registered logos. Rows without a logo get one of many keys by a hash of the
    row, so that they spread over the join's tasks instead of meeting in one."""
    known = logos.filter(F.col("logo_url").isNotNull()).select(F.col("logo_url").alias("_logo"), "logo_id")
    salt = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*rows.columns), F.lit(LOGO_SALTS)).cast("string"))
    keyed = rows.withColumn("_key", F.coalesce("logo_url", salt))
    return keyed.join(known, F.col("_key") == F.col("_logo"), "left").drop("_key", "_logo")


def base_jobs(jobs: DataFrame, categories: Patterns = CATEGORY_PATTERNS) -> DataFrame:
    """The bases of both boards in one pass over the canonical table: each column is chosen per row by its source.

    Gives the rows that ``topcv_base`` and ``itviec_base`` give of the boards' staging tables.
    """
    is_topcv = F.col("source") == "topcv"

    def either(topcv: Column, itviec: Column) -> Column:
        return F.when(is_topcv, topcv).otherwise(itviec)

    told = F.concat_ws(" ", "requirements", "experience")
    first = jobs.filter(F.col("source").isin("topcv", "itviec")).select(
        F.col("source").alias("source_platform"), trim_blanks(F.col("url")).alias("url"),
        trim_blanks(F.col("logo_url")).alias("logo_url"), title_case(F.col("title")).alias("title"),
        upper_trim(F.col("company")).alias("company"), normal_location(title_case(F.col("location"))).alias("working_location"),
        either(title_case(F.col("work_arrangement")), F.lit("Full-time")).alias("work_arrangement"),
        either(F.lit("On-Site"), title_case(F.col("work_model"))).alias("work_model"),
        F.when(is_topcv, F.replace(title_case(F.col("salary")), F.lit(","), F.lit(""))).alias("salary"),
        either(title_case(F.col("requirements")), lower_trim(told)).alias("_education"),
        either(lower_trim(F.col("experience")), lower_trim(told)).alias("_experience"),
        lower_trim(F.col("description")).alias("descriptions"),
        either(lower_trim(F.col("requirements")), lower_trim(told)).alias("requirements"),
        either(F.col("tags"), title_case(F.col("tags"))).alias("tags"), F.col("posted").alias("posted_to_discord"),
        F.to_date("crawled_at").alias("job_posted_date"), F.col("crawled_at").alias("job_posted_timestamp"),
    )
    read = first.withColumns({
        "salary_min_million": min_salary(F.col("salary")),
        "salary_max_million": max_salary(F.col("salary")),
        "education_requirement": education_level(F.col("_education")),
        "year_of_experiences": experience_phrase(F.col("_experience")),
    })
    return categorize(read, categories).select(*_BASE)


def fact_jobs(
    topcv: DataFrame, itviec: DataFrame, logos: DataFrame | None = None, cities: Patterns = CITY_PATTERNS
) -> DataFrame:
    """The fact table of two bases."""
    return fact_of(topcv.unionByName(itviec), logos, cities)


def fact_of(base: DataFrame, logos: DataFrame | None = None, cities: Patterns = CITY_PATTERNS) -> DataFrame:
    """The fact table of a base: list explode, city match, logo join, keys and classes, each row read once."""
    placed = map_city(explode_locations(base), cities)
    if logos is None:
        placed = placed.withColumn("logo_id", F.md5("logo_url"))
    else:
        placed = join_logos(placed, logos)
    measured = placed.withColumns({
        "salary_avg_million": mid_salary(F.col("salary_min_million"), F.col("salary_max_million")),
        "years": experience_years(F.col("year_of_experiences")),
    })
    return measured.select(
        surrogate_key(F.col("source_platform"), F.col("url")).alias("job_id"),
        "source_platform", "url", "logo_id",
        F.col("title").alias("job_title"),
        F.col("company").alias("company_name"),
        "job_location", "job_category",
        work_model(F.col("work_model")).alias("work_model_normalized"),
        work_arrangement(F.col("work_arrangement")).alias("work_arrangement_normalized"),
        "salary", "salary_min_million", "salary_max_million", "salary_avg_million",
        salary_band(F.col("salary_avg_million")).alias("salary_band"),
        "education_requirement", "descriptions", "requirements",
        F.col("year_of_experiences").alias("year_of_experiences_raw"),
        F.col("years").alias("year_of_experiences_normalized"),
        experience_band(F.col("years")).alias("year_of_experiences"),
        experience_rank(F.col("years")).alias("experiences_level"),
        "tags", "posted_to_discord", "job_posted_date", "job_posted_timestamp",
    )


def classified(fact: DataFrame) -> DataFrame:
    """Postings with a known category."""
    return fact.filter(F.col("job_category").isNotNull() & (F.col("job_category") != OTHERS))


def job_fact(fact: DataFrame) -> DataFrame:
    """Gold projection: surrogate keys and attributes of classified postings."""
    keys = {
        "job_category_id": ("job_category",),
        "company_id": ("source_platform", "company_name"),
        "job_id": ("source_platform", "url"),
        "work_model_id": ("work_model_normalized",),
        "location_id": ("job_location",),
        "education_id": ("education_requirement",),
        "salary_band_id": ("salary_band",),
    }
    return classified(fact).select(
        *[surrogate_key(*map(F.col, cols)).alias(name) for name, cols in keys.items()],
        "source_platform", "url", "logo_id", "job_title", "year_of_experiences",
        "experiences_level", "work_arrangement_normalized", "salary_avg_million", "salary",
        "tags", "job_posted_date",
    )


def master_date(gold_fact: DataFrame) -> DataFrame:
    from ..functions.dates import calendar_parts

    days = gold_fact.select(F.col("job_posted_date").alias("date")).distinct()
    return days.withColumns(calendar_parts(F.col("date")))
