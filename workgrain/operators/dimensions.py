"""Silver dimensions, each one row per value with hiring measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import surrogate_key
from .measures import grouped, share, with_total
from .warehouse import classified


#: What the company dimension measures: arguments of ``measures.grouped`` and of ``marts.Mart``.
COMPANY = {
    "keys": ["source_platform", "company_name"], "flags": ["any", "posted"],
    "distinct": ["job_location"], "sets": ["work_model_normalized"],
}


def dim_company(fact: DataFrame) -> DataFrame:
    return company_measures(grouped(classified(fact), **COMPANY))


def company_measures(groups: DataFrame) -> DataFrame:
    """The company dimension of measured groups, however these were made."""
    return groups.select(
        surrogate_key(F.col("source_platform"), F.col("company_name")).alias("company_id"),
        "company_name", "source_platform",
        F.col("n_any").alias("total_job_postings"),
        F.col("d_job_location").alias("num_locations"),
        F.col("n_posted").alias("discord_postings"),
        share(F.col("n_posted"), F.nullif("n_any", F.lit(0))).alias("pct_discord_posted"),
        F.col("first_date").alias("first_posting_date"),
        F.col("last_date").alias("last_posting_date"),
        F.col("avg_salary").alias("avg_salary_offered"),
        F.array_join("s_work_model_normalized", ", ").alias("work_models_offered"),
    )


def dim_location(fact: DataFrame) -> DataFrame:
    """``fulltime_jobs`` tests the arrangement; work models never hold that value."""
    groups = grouped(
        classified(fact), ["job_location"],
        flags=["any", "remote", "hybrid", "onsite", "fulltime"],
        distinct=["company_name", "source_platform"], sets=["education_requirement"],
    )
    return groups.select(
        surrogate_key(F.col("job_location")).alias("location_id"),
        "job_location",
        F.col("n_any").alias("total_jobs"),
        F.col("d_company_name").alias("num_companies"),
        F.col("d_source_platform").alias("num_platforms"),
        F.col("avg_salary").alias("avg_salary_by_location"),
        F.col("salary_high").alias("highest_salary"),
        F.col("salary_low").alias("lowest_salary"),
        *[F.col(f"n_{f}").alias(f"{f}_jobs") for f in ("remote", "hybrid", "onsite", "fulltime")],
        F.array_join("s_education_requirement", ", ").alias("education_requirements"),
    )


def dim_education(fact: DataFrame) -> DataFrame:
    known = classified(fact).filter(F.col("education_requirement") != "Not Specified")
    groups = grouped(
        known, ["education_requirement"],
        distinct=["company_name", "job_location"], sets=["source_platform"],
    )
    total = fact.agg(F.count("*").alias("total"))
    return with_total(groups, total).select(
        surrogate_key(F.col("education_requirement")).alias("education_id"),
        "education_requirement",
        F.col("rows").alias("job_count"),
        F.col("d_company_name").alias("num_companies"),
        F.col("d_job_location").alias("num_locations"),
        "avg_salary",
        share(F.col("rows"), F.col("total")).alias("pct_of_total_jobs"),
        F.array_join("s_source_platform", ", ").alias("source_platforms"),
    )


def dim_salary_band(fact: DataFrame) -> DataFrame:
    # A band is named exactly when one of the bounds is known.
    salaried = fact.filter(F.coalesce("salary_min_million", "salary_max_million").isNotNull())
    groups = grouped(
        classified(salaried), ["salary_band", "salary_min_million", "salary_max_million"],
        distinct=["company_name", "job_location", "source_platform"],
    )
    total = salaried.agg(F.count("*").alias("total"))
    return with_total(groups, total).select(
        surrogate_key(F.col("salary_band")).alias("salary_band_id"),
        "salary_band",
        F.col("rows").alias("job_count"),
        F.col("d_company_name").alias("num_companies"),
        F.col("d_job_location").alias("num_locations"),
        "salary_min_million", "salary_max_million",
        F.col("avg_salary").alias("avg_salary_in_band"),
        F.col("d_source_platform").alias("num_platforms"),
        share(F.col("rows"), F.col("total")).alias("pct_of_salaried_jobs"),
    )


def dim_work_model(fact: DataFrame) -> DataFrame:
    groups = grouped(
        classified(fact), ["work_model_normalized"], flags=["any"],
        distinct=["company_name", "job_location", "source_platform"],
    )
    total = fact.agg(F.count_distinct("url").alias("total"))
    return with_total(groups, total).select(
        surrogate_key(F.col("work_model_normalized")).alias("work_model_id"),
        "work_model_normalized",
        F.col("n_any").alias("job_count"),
        F.col("d_company_name").alias("num_companies"),
        F.col("d_job_location").alias("num_locations"),
        "avg_salary",
        share(F.col("n_any"), F.col("total")).alias("pct_of_total_jobs"),
        F.col("d_source_platform").alias("num_platforms"),
    )


def dim_company_logo(logos: DataFrame) -> DataFrame:
    return logos.select("logo_id", "logo_path").distinct()
