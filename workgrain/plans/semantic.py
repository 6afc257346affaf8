"""Queries of the semantic layer and the reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dimensions as dims
from ..operators import gold, semantic
from ..operators import warehouse as wh
from . import sql
from .fixtures import jobs_raw
from .registry import query
from .warehouse import GOLD_DAY, fact, logos, stored_fact


class Star:
    """The fact table, its gold projection and the dimensions reports read."""

    def __init__(self, spark, sf):
        self.rows = stored_fact(spark, sf)
        self.fact = wh.job_fact(self.rows)
        self.logos = logos(spark, sf)

    def category(self):
        return gold.job_category_analysis(self.rows).select("job_category_id", "job_category")

    def location(self):
        return dims.dim_location(self.rows).select("location_id", "job_location")

    def logo(self):
        path = F.concat(F.lit("logos/"), "logo_id", F.lit(".png"))
        return dims.dim_company_logo(self.logos.withColumn("logo_path", path))

    def salary_band(self):
        return gold.salary_benchmark(self.rows).select("salary_band_id", "salary_band")

    def company(self):
        day = F.lit(GOLD_DAY).cast("date")
        summary = gold.company_hiring_summary(dims.dim_company(self.rows), self.rows, day)
        return summary.select("company_id", "company_name")

    def work_model(self):
        return dims.dim_work_model(self.rows).select("work_model_id", "work_model_normalized")

    def education(self):
        return dims.dim_education(self.rows).select("education_id", "education_requirement")

    def date(self):
        return wh.master_date(self.fact).select("date", "year", "week_of_year")

    def join(self, *names):
        return semantic.star(self.fact, **{name: getattr(self, name)() for name in names})


@query("n1_cube", sql.JOBS + """SELECT source, experience, CAST(date_trunc('quarter', crawled_at) AS DATE) AS crawled_at,
  count(*) AS count FROM jobs_raw WHERE source IN ('topcv', 'linkedin') GROUP BY ALL""")
def n1(spark, sf):
    return semantic.cube(
        jobs_raw(spark, sf), dimensions=["source", "experience"], time_grain="quarter",
        filters={"source": ["topcv", "linkedin"]},
    )


@query("n2_measures", sql.FACT + """SELECT source_platform, round(nullif(avg(salary_avg_million), 0), 1) AS avg_salary,
  round(avg(salary_avg_million), 1) AS avg_salary_plain, count(job_id) AS jobs,
  count(DISTINCT source_platform) AS platforms,
  count(DISTINCT source_platform || '|' || company_name) AS companies FROM classified GROUP BY source_platform""")
def n2(spark, sf):
    known = semantic.measures()
    shown = [
        (F.round(c, 1) if name.startswith("avg") else c).alias(name) for name, c in known.items()
    ]
    rows = wh.job_fact(fact(spark, sf)).withColumn("platform", F.col("source_platform"))
    return rows.groupBy("platform").agg(*shown).withColumnRenamed("platform", "source_platform")


@query("n3_jobs_per_date_category", sql.FACT + """SELECT job_posted_date AS date, job_category, count(job_id) AS jobs
  FROM classified GROUP BY ALL""")
def n3(spark, sf):
    joined = Star(spark, sf).join("category", "date")
    return semantic.jobs_by_date_and_category(joined)


PIVOT = ", ".join(
    f"""round(avg(salary_avg_million) FILTER (year_of_experiences = '{b}'), 1) AS "{b}" """
    for b in semantic.EXPERIENCE_BANDS
)


@query("n4_salary_pivot", sql.FACT + f"SELECT job_category, {PIVOT} FROM classified GROUP BY job_category")
def n4(spark, sf):
    return semantic.salary_pivot(Star(spark, sf).join("category"))


@query("n5_salary_tree", sql.FACT + """SELECT year_of_experiences, job_category, job_location, work_model_normalized,
  education_requirement, sum(salary_avg_million) AS salary_sum FROM classified GROUP BY ALL""")
def n5(spark, sf):
    joined = Star(spark, sf).join("category", "location", "work_model", "education")
    return semantic.salary_tree(joined)


@query("n6_jobs_per_location", sql.FACT + """SELECT job_location, count(job_id) AS jobs FROM classified GROUP BY ALL""")
def n6(spark, sf):
    return semantic.jobs_by_location(Star(spark, sf).join("location"))


@query("n7_cards", sql.FACT + """SELECT count(job_id) AS jobs, count(DISTINCT source_platform) AS platforms,
  count(DISTINCT source_platform || '|' || company_name) AS companies,
  round(nullif(avg(salary_avg_million), 0), 1) AS avg_salary FROM classified""")
def n7(spark, sf):
    return semantic.cards(wh.job_fact(fact(spark, sf)))


BOARD = """SELECT job_id, job_title, 'logos/' || logo_id || '.png' AS logo_path, company_name, job_location, salary,
  salary_band, tags, year_of_experiences, url FROM classified"""


@query("n8_job_board", sql.FACT + BOARD)
def n8(spark, sf):
    joined = Star(spark, sf).join("logo", "company", "location", "salary_band")
    return semantic.job_board(joined)


@query("p17_slicers", sql.FACT + """SELECT job_id, job_title, experiences_level, source_platform, job_location,
  work_arrangement_normalized FROM classified WHERE contains(lower(job_title), 'engineer')
  AND experiences_level IN ('Junior', 'Mid-level') AND source_platform = 'topcv'
  AND job_location IN ('Ha Noi', 'Da Nang') AND work_arrangement_normalized = 'Full-time'""")
def p17(spark, sf):
    joined = Star(spark, sf).join("location")
    rows = semantic.slice_rows(
        joined, "Engineer", experiences_level=["Junior", "Mid-level"], source_platform=["topcv"],
        job_location=["Ha Noi", "Da Nang"], work_arrangement_normalized=["Full-time"],
    )
    return rows.select(
        "job_id", "job_title", "experiences_level", "source_platform", "job_location",
        "work_arrangement_normalized",
    )


@query("j7_star_joins", sql.FACT + """SELECT job_id, company_name, job_location, job_category, work_model_normalized,
  education_requirement, salary_band, CAST(year(job_posted_date) AS INTEGER) AS year FROM classified""")
def j7(spark, sf):
    joined = Star(spark, sf).join(
        "company", "location", "category", "salary_band", "work_model", "education", "date"
    )
    return joined.select(
        "job_id", "company_name", "job_location", "job_category", "work_model_normalized",
        "education_requirement", "salary_band", "year",
    )


@query("j8_date_part_join", sql.FACT + """SELECT f.job_id, f.job_posted_timestamp, d.date,
  CAST(week(d.date) AS INTEGER) AS week_of_year FROM fact f LEFT JOIN
  (SELECT DISTINCT job_posted_date AS date FROM classified) d ON CAST(f.job_posted_timestamp AS DATE) = d.date""")
def j8(spark, sf):
    tables = Star(spark, sf)
    calendar = tables.date().select("date", "week_of_year")
    timed = tables.rows.select("job_id", "job_posted_timestamp")
    return semantic.join_date_part(timed, "job_posted_timestamp", calendar)
