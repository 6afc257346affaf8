"""Gold marts: market summaries, rankings and comparisons with the market mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_active
from ..functions.text import surrogate_key
from .measures import global_rank, grouped, share, with_total
from .ranking import numbered, quantiles
from .warehouse import classified


def with_mean(rows: DataFrame, measure: str, name: str) -> DataFrame:
    """Adds the mean over all rows as a scalar subquery."""
    return rows.withColumn(name, rows.agg(F.avg(measure)).scalar())


def ranked(rows: DataFrame, measure: str, ident: str, name: str) -> DataFrame:
    """Adds the place by falling measure, then by the name of the row."""
    return numbered(rows, [F.col(measure).desc_nulls_last(), F.col(ident).asc_nulls_last()], name)


def job_category_analysis(fact: DataFrame) -> DataFrame:
    groups = grouped(
        classified(fact), ["job_category"], flags=["remote", "hybrid", "bachelor"],
        distinct=["company_name", "job_location"],
    )
    total = fact.agg(F.count("*").alias("total"))
    return with_total(ranked(groups, "rows", "job_category", "title_rank"), total).select(
        surrogate_key(F.col("job_category")).alias("job_category_id"),
        "title_rank", "job_category",
        F.col("rows").alias("num_positions"),
        F.col("d_company_name").alias("num_companies"),
        F.col("d_job_location").alias("num_locations"),
        share(F.col("rows"), F.col("total")).alias("pct_of_all_jobs"),
        "avg_salary",
        F.col("salary_low").alias("min_salary"),
        F.col("salary_high").alias("max_salary"),
        F.col("n_remote").alias("remote_positions"),
        F.col("n_hybrid").alias("hybrid_positions"),
        share(F.col("n_bachelor"), F.col("rows")).alias("pct_bachelor_required"),
    )


#: What the daily market measures: arguments of ``measures.grouped`` and of ``marts.Mart``.
DAILY = {
    "keys": ["job_posted_date", "source_platform"],
    "flags": ["posted", "remote", "hybrid", "fulltime", "onsite", "bachelor"], "distinct": ["company_name", "job_location"],
}


def job_market_daily(fact: DataFrame) -> DataFrame:
    return daily_measures(grouped(classified(fact), **DAILY))


def daily_measures(groups: DataFrame) -> DataFrame:
    """Delivered postings count distinct urls, full-time ones test the arrangement."""
    return groups.select(
        "job_posted_date", "source_platform",
        F.col("rows").alias("daily_job_postings"),
        F.col("d_company_name").alias("unique_companies_posting"),
        F.col("d_job_location").alias("unique_locations"),
        F.col("n_posted").alias("discord_posted_count"),
        share(F.col("n_posted"), F.col("rows")).alias("pct_posted_to_discord"),
        F.col("avg_salary").alias("avg_salary_offered"),
        F.col("salary_high").alias("max_salary_offered"),
        F.col("salary_low").alias("min_salary_offered"),
        *[F.col(f"n_{f}").alias(f"{f}_jobs") for f in ("remote", "hybrid", "fulltime", "onsite")],
        F.col("n_bachelor").alias("bachelor_required_count"),
    )


def platform_comparison(fact: DataFrame) -> DataFrame:
    groups = grouped(
        classified(fact), ["source_platform"],
        flags=["any", "posted", "remote", "hybrid", "fulltime", "onsite", "bachelor", "salaried"],
        distinct=["company_name", "job_location", "job_title"],
    )
    return groups.select(
        "source_platform",
        F.col("rows").alias("total_job_postings"),
        F.col("d_company_name").alias("unique_companies"),
        F.col("d_job_location").alias("unique_locations"),
        F.col("d_job_title").alias("unique_job_titles"),
        share(F.col("n_posted"), F.col("rows")).alias("pct_discord_posted"),
        *[
            F.col(f"n_{f}").alias(f"{f}_jobs_count")
            for f in ("remote", "hybrid", "fulltime", "onsite")
        ],
        share(F.col("n_bachelor"), F.nullif("n_any", F.lit(0))).alias("pct_bachelor_required"),
        "avg_salary",
        F.col("n_salaried").alias("salaried_positions_count"),
        F.col("first_date").alias("earliest_job_date"),
        F.col("last_date").alias("latest_job_date"),
    )


def salary_benchmark(fact: DataFrame, exact: bool = True) -> DataFrame:
    """Quartiles per band. ``exact`` ranks the counted values; otherwise sketches are merged."""
    rows = classified(fact)
    groups = grouped(
        rows, ["salary_band"], flags=["salaried", "remote", "hybrid", "onsite"]
    )
    points = {"salary_q1": 0.25, "salary_median": 0.50, "salary_q3": 0.75}
    names = tuple(points)
    if exact:
        quartiles = quantiles(rows, ["salary_band"], "salary_avg_million", points)
    else:
        quartiles = rows.groupBy("salary_band").agg(
            *[F.percentile_approx("salary_avg_million", p).cast("double").alias(n) for n, p in points.items()])
    return groups.join(quartiles, "salary_band", "left").select(
        surrogate_key(F.col("salary_band")).alias("salary_band_id"),
        "salary_band",
        F.col("rows").alias("num_positions"),
        F.col("n_salaried").alias("salaried_positions"),
        "avg_salary", *names,
        F.col("salary_low").alias("min_salary"),
        F.col("salary_high").alias("max_salary"),
        F.col("n_remote").alias("remote_positions"),
        F.col("n_hybrid").alias("hybrid_positions"),
        F.col("n_onsite").alias("on_site_positions"),
    )


def company_hiring_summary(companies: DataFrame, fact: DataFrame, as_of: Column) -> DataFrame:
    """Company measures joined to what their classified postings offer, with a global rank."""
    offers = classified(fact).groupBy("company_name", "source_platform").agg(
        F.count_distinct("job_location").alias("unique_locations_hiring"),
        F.count_distinct("job_title").alias("unique_job_titles"),
    )
    joined = companies.join(offers, ["company_name", "source_platform"])
    ranked = global_rank(joined, "total_job_postings", "company_id", "company_rank")
    return ranked.select(
        "company_id", "company_rank", "company_name", "source_platform", "total_job_postings",
        "num_locations", "discord_postings", "pct_discord_posted",
        days_active(F.col("first_posting_date"), as_of).alias("active_days_range"),
        "first_posting_date", "last_posting_date", "avg_salary_offered",
        "unique_locations_hiring", "unique_job_titles", "work_models_offered",
    )


def education_distribution(education: DataFrame) -> DataFrame:
    gap = F.col("avg_salary") - F.col("market_avg_salary")
    placed = with_mean(ranked(education, "job_count", "education_requirement", "demand_rank"), "avg_salary", "_mean")
    return placed.withColumn("market_avg_salary", F.round("_mean", 1)).drop("_mean").withColumns({
        "salary_vs_market": gap,
        "salary_vs_market_pct": F.round(gap / F.col("market_avg_salary") * 100, 2),
    })


def work_model_analysis(models: DataFrame) -> DataFrame:
    placed = with_mean(ranked(models, "job_count", "work_model_normalized", "demand_rank"), "avg_salary", "_mean")
    return placed.withColumns({
        "market_avg_salary": F.round("_mean", 1),
        "salary_vs_market": F.round(F.col("avg_salary") - F.col("_mean"), 1),
        "salary_positioning": F.when(F.col("avg_salary") > F.col("_mean"), "Above Average")
        .when(F.col("avg_salary") < F.col("_mean"), "Below Average")
        .otherwise("At Market"),
    }).drop("_mean")


def location_salary_analysis(locations: DataFrame, fact: DataFrame) -> DataFrame:
    total = fact.agg(F.count("*").alias("total"))
    return with_total(ranked(locations, "avg_salary_by_location", "location_id", "salary_rank"), total).select(
        "salary_rank", "location_id", "job_location", "total_jobs", "num_companies", "num_platforms",
        share(F.col("total_jobs"), F.col("total")).alias("pct_of_total_jobs"),
        "avg_salary_by_location", "highest_salary", "lowest_salary",
        "remote_jobs", "hybrid_jobs", "onsite_jobs", "fulltime_jobs",
        share(F.col("remote_jobs"), F.nullif("total_jobs", F.lit(0))).alias("pct_remote"),
        share(F.col("hybrid_jobs"), F.nullif("total_jobs", F.lit(0))).alias("pct_hybrid"),
        "education_requirements",
    )


def job_daily_snapshot(gold_fact: DataFrame) -> DataFrame:
    return gold_fact.groupBy("job_posted_date", "source_platform").agg(
        F.count("*").alias("total_jobs")
    )
