"""Queries over the warehouse layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dimensions as dims
from ..operators import gold
from ..operators import warehouse as wh
from ..session import scratch_dir
from ..sources.tables import layer
from . import sql
from .fixtures import JOBS_RAW, jobs_raw, staging_itviec, staging_topcv, table
from .registry import ORACLES, query
from .sql import with_

GOLD_DAY = "2001-08-02"
LAYERS = with_(sql.JOBS_SQL, *sql.SEEDS_SQL, *sql.BRONZE_SQL, *sql.BASE_SQL)


def logos(spark: SparkSession, sf: str) -> DataFrame:
    """Registered logos: those of one source, so the join has both outcomes."""
    orders = table(spark, sf, "orders").selectExpr(*(f"{JOBS_RAW[c]} AS {c}" for c in ("source", "logo_url")))
    urls = orders.filter("source = 'topcv'").select(F.trim("logo_url").alias("logo_url"))
    known = urls.filter(F.col("logo_url").isNotNull()).distinct()
    return known.withColumn("logo_id", F.md5("logo_url"))


def bases(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    jobs = jobs_raw(spark, sf)
    topcv = wh.topcv_base(wh.bronze_topcv(staging_topcv(jobs)))
    itviec = wh.itviec_base(wh.bronze_itviec(staging_itviec(jobs)))
    return topcv, itviec


def fact(spark: SparkSession, sf: str) -> DataFrame:
    return wh.fact_of(wh.base_jobs(jobs_raw(spark, sf)), logos(spark, sf))


def stored_fact(spark: SparkSession, sf: str) -> DataFrame:
    """The fact table as a layer that all queries over the same files share."""
    return layer(spark, "fact_jobs", [f"{sf}/orders.parquet", f"{sf}/customer.parquet"], lambda: fact(spark, sf))


def share(part: str, whole: str) -> str:
    return f"round({part} * 100.0 / {whole}, 2)"


def mean(col: str = "salary_avg_million") -> str:
    return f"round(avg({col}), 1)"


def urls(condition: str) -> str:
    return f"count(DISTINCT CASE WHEN {condition} THEN url END)"


REMOTE, HYBRID, ONSITE = (f"work_model_normalized = '{m}'" for m in ("Remote", "Hybrid", "On-Site"))
FULLTIME = "work_arrangement_normalized = 'Full-time'"
BACHELOR = "education_requirement = 'Bachelor'"


@query("p1_bronze_topcv", LAYERS + "SELECT * FROM bronze_topcv")
def p1_topcv(spark, sf):
    return wh.bronze_topcv(staging_topcv(jobs_raw(spark, sf)))


@query("p1_bronze_itviec", LAYERS + "SELECT * FROM bronze_itviec")
def p1_itviec(spark, sf):
    return wh.bronze_itviec(staging_itviec(jobs_raw(spark, sf)))


@query("p3_ingest_topcv", LAYERS + f"""SELECT id, url, level_of_education,
  {sql.education('level_of_education')} AS least_level_of_education, {sql.phrase('experiences')} AS exp
  FROM bronze_topcv""")
def p3_topcv(spark, sf):
    rows = wh.ingest_topcv(wh.bronze_topcv(staging_topcv(jobs_raw(spark, sf))))
    return rows.select("id", "url", "level_of_education", "least_level_of_education", "exp")


@query("p3_ingest_itviec", LAYERS + f"""SELECT id, url, requirements_and_experiences,
  {sql.education('requirements_and_experiences')} AS least_level_of_education,
  {sql.phrase('requirements_and_experiences')} AS exp FROM bronze_itviec""")
def p3_itviec(spark, sf):
    rows = wh.ingest_itviec(wh.bronze_itviec(staging_itviec(jobs_raw(spark, sf))))
    return rows.select("id", "url", "requirements_and_experiences", "least_level_of_education", "exp")


def _unified_sql(source: str, salary: str, education: str, exp: str) -> str:
    return f"""SELECT '{source}' AS source, url, title, company AS company_name, working_location,
  work_model, {salary} AS salary, {sql.education(education)} AS least_level_of_education,
  {sql.phrase(exp)} AS experience_required, created_at FROM bronze_{source}"""


@query("x1_union_all_sources", LAYERS
       + _unified_sql("itviec", "CAST(NULL AS VARCHAR)", "requirements_and_experiences", "requirements_and_experiences")
       + " UNION ALL " + _unified_sql("topcv", "salary", "level_of_education", "experiences"))
def x1(spark, sf):
    jobs = jobs_raw(spark, sf)
    return wh.jobs_unified(
        wh.ingest_topcv(wh.bronze_topcv(staging_topcv(jobs))),
        wh.ingest_itviec(wh.bronze_itviec(staging_itviec(jobs))),
    )


@query("n11_one_pass_bases", LAYERS + "SELECT * FROM topcv_base UNION ALL SELECT * FROM itviec_base")
def n11_one_pass(spark, sf):
    return wh.base_jobs(jobs_raw(spark, sf))


@query("n11_topcv_base", LAYERS + "SELECT * FROM topcv_base")
def n11_topcv(spark, sf):
    return bases(spark, sf)[0]


@query("n11_itviec_base", LAYERS + "SELECT * FROM itviec_base")
def n11_itviec(spark, sf):
    return bases(spark, sf)[1]


@query("p4_typed_nulls", LAYERS + """SELECT source_platform, count(*) AS jobs, count(salary) AS with_salary,
  count(salary_min_million) AS with_min, count(salary_max_million) AS with_max
  FROM (SELECT * FROM topcv_base UNION ALL SELECT * FROM itviec_base) GROUP BY source_platform""")
def p4(spark, sf):
    topcv, itviec = bases(spark, sf)
    return topcv.unionByName(itviec).groupBy("source_platform").agg(
        F.count("*").alias("jobs"), F.count("salary").alias("with_salary"),
        F.count("salary_min_million").alias("with_min"),
        F.count("salary_max_million").alias("with_max"),
    )


@query("j1_category_regex_join", LAYERS + """SELECT b.id, coalesce(m.target, 'Others') AS job_category
  FROM bronze_topcv b LEFT JOIN category_map m ON regexp_matches(lower(b.title), m.pattern)""")
def j1(spark, sf):
    rows = wh.categorize(wh.bronze_topcv(staging_topcv(jobs_raw(spark, sf))))
    return rows.select("id", "job_category")


@query("j2_city_regex_join", with_(*sql.FACT_CTES[:-3]) + """SELECT e.url, e.working_location, c.city_en AS job_location
  FROM exploded e LEFT JOIN city_map c ON regexp_matches(e.working_location, c.pattern)""")
def j2(spark, sf):
    topcv, itviec = bases(spark, sf)
    rows = wh.map_city(wh.explode_locations(topcv.unionByName(itviec)))
    return rows.select("url", "working_location", "job_location")


@query("f4_split_explode", LAYERS + """SELECT url, trim(place) AS working_location
  FROM (SELECT url, unnest(string_split(working_location, '-')) AS place FROM topcv_base)
  WHERE NOT contains(place, 'nơi khác')""")
def f4(spark, sf):
    return wh.explode_locations(bases(spark, sf)[0]).select("url", "working_location")


@query("j3_logo_join", with_(sql.JOBS_SQL, *sql.BRONZE_SQL, sql.LOGOS_SQL) + """SELECT b.id, b.logo_url, l.logo_id
  FROM (SELECT id, logo_url FROM bronze_topcv UNION ALL SELECT id, logo_url FROM bronze_itviec) b
  LEFT JOIN logos l ON b.logo_url = l.logo_url""")
def j3(spark, sf):
    jobs = jobs_raw(spark, sf)
    rows = wh.bronze_topcv(staging_topcv(jobs)).select("id", "logo_url").unionByName(
        wh.bronze_itviec(staging_itviec(jobs)).select("id", "logo_url")
    )
    return wh.join_logos(rows, logos(spark, sf)).select("id", "logo_url", "logo_id")


@query("n10_fact_jobs", sql.FACT + "SELECT * FROM fact")
def n10(spark, sf):
    return fact(spark, sf)


GOLD_FACT = f"""SELECT {sql.key('job_category')} AS job_category_id,
  {sql.key('source_platform', 'company_name')} AS company_id, {sql.key('source_platform', 'url')} AS job_id,
  {sql.key('work_model_normalized')} AS work_model_id, {sql.key('job_location')} AS location_id,
  {sql.key('education_requirement')} AS education_id, {sql.key('salary_band')} AS salary_band_id,
  source_platform, url, logo_id, job_title, year_of_experiences, experiences_level,
  work_arrangement_normalized, salary_avg_million, salary, tags, job_posted_date FROM classified"""


@query("n9_job_fact", sql.FACT + GOLD_FACT)
def n9(spark, sf):
    return wh.job_fact(fact(spark, sf))


@query("p10_category_gate", sql.FACT + """SELECT job_category, count(*) AS jobs FROM classified GROUP BY job_category""")
def p10(spark, sf):
    return wh.classified(fact(spark, sf)).groupBy("job_category").agg(F.count("*").alias("jobs"))


@query("f5_surrogate_keys", sql.FACT + f"""SELECT DISTINCT {sql.key('source_platform', 'company_name')} AS company_id,
  {sql.key('job_location')} AS location_id, company_name, job_location FROM fact""")
def f5(spark, sf):
    from ..functions.text import surrogate_key

    return fact(spark, sf).select(
        surrogate_key(F.col("source_platform"), F.col("company_name")).alias("company_id"),
        surrogate_key(F.col("job_location")).alias("location_id"),
        "company_name", "job_location",
    ).distinct()


@query("n12_calendar", sql.FACT + """SELECT DISTINCT job_posted_date AS date,
  CAST(month(job_posted_date) AS INTEGER) AS month, CAST(quarter(job_posted_date) AS INTEGER) AS quarter,
  CAST(year(job_posted_date) AS INTEGER) AS year, CAST(day(job_posted_date) AS INTEGER) AS day_of_month,
  CAST(week(job_posted_date) AS INTEGER) AS week_of_year, CAST(month(job_posted_date) AS INTEGER) AS month_of_year
  FROM classified""")
def n12(spark, sf):
    return wh.master_date(wh.job_fact(fact(spark, sf)))


DIM_COMPANY = f"""SELECT {sql.key('source_platform', 'company_name')} AS company_id, company_name, source_platform,
  count(DISTINCT url) AS total_job_postings, count(DISTINCT job_location) AS num_locations,
  {urls('posted_to_discord')} AS discord_postings,
  {share(urls('posted_to_discord'), 'nullif(count(DISTINCT url), 0)')} AS pct_discord_posted,
  min(job_posted_date) AS first_posting_date, max(job_posted_date) AS last_posting_date,
  {mean()} AS avg_salary_offered,
  coalesce(array_to_string(list_sort(list(DISTINCT work_model_normalized)), ', '), '') AS work_models_offered
  FROM classified GROUP BY source_platform, company_name"""


@query("a1_dim_company", sql.FACT + DIM_COMPANY)
def a1(spark, sf):
    return dims.dim_company(stored_fact(spark, sf))


def kept_by_deltas(spark: SparkSession, sf: str, layout: dict) -> DataFrame:
    """Measured groups after three batches: older postings in an earlier state, then their changes and new postings,
    then the removal of postings that were never there."""
    from ..operators.marts import Mart

    rows = wh.classified(stored_fact(spark, sf)).withColumn("_key", F.pmod(F.xxhash64("url"), F.lit(10)))
    current = rows.drop("_key")
    early = rows.filter("_key < 7 AND url IS NOT NULL").withColumns({
        "job_location": F.when(F.col("_key") < 3, F.lit("Ha Noi")).otherwise(F.col("job_location")),
        "salary_avg_million": F.when(F.col("_key") < 2, F.lit(None)).otherwise(F.col("salary_avg_million")).cast(rows.schema["salary_avg_million"].dataType),
        "company_name": F.when(F.col("_key") < 1, F.lit("AN EARLIER NAME")).otherwise(F.col("company_name")),
    }).drop("_key")
    gone = early.filter(F.col("company_name") == "AN EARLIER NAME").withColumn("url", F.concat("url", F.lit("#gone")))
    mart = Mart(spark, scratch_dir(spark, "mart"), **layout)
    mart.update(early.unionByName(gone), number=1)
    mart.update(current.filter(F.pmod(F.xxhash64("url"), F.lit(10)).isin(0, 1, 2, 7, 8, 9) | F.col("url").isNull()), number=2)
    mart.update(gone.limit(0), removed=gone.select("url"), number=3)
    mart.update(early, number=3)  # a number that has been applied
    return mart.read()


@query("a1_company_by_deltas", sql.FACT + DIM_COMPANY)
def a1_deltas(spark, sf):
    return dims.company_measures(kept_by_deltas(spark, sf, dims.COMPANY))


DIM_LOCATION = f"""SELECT {sql.key('job_location')} AS location_id, job_location, count(DISTINCT url) AS total_jobs,
  count(DISTINCT company_name) AS num_companies, count(DISTINCT source_platform) AS num_platforms,
  {mean()} AS avg_salary_by_location, max(salary_max_million) AS highest_salary,
  min(salary_min_million) AS lowest_salary, {urls(REMOTE)} AS remote_jobs, {urls(HYBRID)} AS hybrid_jobs,
  {urls(ONSITE)} AS onsite_jobs, {urls(FULLTIME)} AS fulltime_jobs,
  array_to_string(list_sort(list(DISTINCT education_requirement)), ', ') AS education_requirements
  FROM classified GROUP BY job_location"""


@query("a2_dim_location", sql.FACT + DIM_LOCATION)
def a2(spark, sf):
    return dims.dim_location(stored_fact(spark, sf))


DIM_EDUCATION = f"""SELECT {sql.key('education_requirement')} AS education_id, education_requirement,
  count(*) AS job_count, count(DISTINCT company_name) AS num_companies,
  count(DISTINCT job_location) AS num_locations, {mean()} AS avg_salary,
  {share('count(*)', '(SELECT count(*) FROM fact)')} AS pct_of_total_jobs,
  array_to_string(list_sort(list(DISTINCT source_platform)), ', ') AS source_platforms
  FROM classified WHERE education_requirement <> 'Not Specified' GROUP BY education_requirement"""


@query("a3_dim_education", sql.FACT + DIM_EDUCATION)
def a3(spark, sf):
    return dims.dim_education(stored_fact(spark, sf))


@query("a4_dim_salary_band", sql.FACT + f"""SELECT {sql.key('salary_band')} AS salary_band_id, salary_band,
  count(*) AS job_count, count(DISTINCT company_name) AS num_companies,
  count(DISTINCT job_location) AS num_locations, salary_min_million, salary_max_million,
  {mean()} AS avg_salary_in_band, count(DISTINCT source_platform) AS num_platforms,
  {share('count(*)', "(SELECT count(*) FROM fact WHERE salary_band <> 'Not Specified')")} AS pct_of_salaried_jobs
  FROM classified WHERE salary_band <> 'Not Specified'
  GROUP BY salary_band, salary_min_million, salary_max_million""")
def a4(spark, sf):
    return dims.dim_salary_band(stored_fact(spark, sf))


DIM_WORK_MODEL = f"""SELECT {sql.key('work_model_normalized')} AS work_model_id, work_model_normalized,
  count(DISTINCT url) AS job_count, count(DISTINCT company_name) AS num_companies,
  count(DISTINCT job_location) AS num_locations, {mean()} AS avg_salary,
  {share('count(DISTINCT url)', '(SELECT count(DISTINCT url) FROM fact)')} AS pct_of_total_jobs,
  count(DISTINCT source_platform) AS num_platforms FROM classified GROUP BY work_model_normalized"""


@query("a5_dim_work_model", sql.FACT + DIM_WORK_MODEL)
def a5(spark, sf):
    return dims.dim_work_model(stored_fact(spark, sf))


@query("a6_job_category_analysis", sql.FACT + f"""SELECT {sql.key('job_category')} AS job_category_id,
  row_number() OVER (ORDER BY count(*) DESC, job_category) AS title_rank, job_category,
  count(*) AS num_positions, count(DISTINCT company_name) AS num_companies,
  count(DISTINCT job_location) AS num_locations,
  {share('count(*)', '(SELECT count(*) FROM fact)')} AS pct_of_all_jobs, {mean()} AS avg_salary,
  min(salary_min_million) AS min_salary, max(salary_max_million) AS max_salary,
  {urls(REMOTE)} AS remote_positions, {urls(HYBRID)} AS hybrid_positions,
  {share(urls(BACHELOR), 'count(*)')} AS pct_bachelor_required FROM classified GROUP BY job_category""")
def a6(spark, sf):
    return gold.job_category_analysis(stored_fact(spark, sf))


@query("a7_job_market_daily", sql.FACT + f"""SELECT job_posted_date, source_platform,
  count(*) AS daily_job_postings, count(DISTINCT company_name) AS unique_companies_posting,
  count(DISTINCT job_location) AS unique_locations, {urls('posted_to_discord')} AS discord_posted_count,
  {share(urls('posted_to_discord'), 'count(*)')} AS pct_posted_to_discord, {mean()} AS avg_salary_offered,
  max(salary_max_million) AS max_salary_offered, min(salary_min_million) AS min_salary_offered,
  {urls(REMOTE)} AS remote_jobs, {urls(HYBRID)} AS hybrid_jobs, {urls(FULLTIME)} AS fulltime_jobs,
  {urls(ONSITE)} AS onsite_jobs, {urls(BACHELOR)} AS bachelor_required_count
  FROM classified GROUP BY job_posted_date, source_platform""")
def a7(spark, sf):
    return gold.job_market_daily(stored_fact(spark, sf))


@query("a7_daily_by_deltas", ORACLES["a7_job_market_daily"])
def a7_deltas(spark, sf):
    return gold.daily_measures(kept_by_deltas(spark, sf, gold.DAILY))


@query("a8_platform_comparison", sql.FACT + f"""SELECT source_platform, count(*) AS total_job_postings,
  count(DISTINCT company_name) AS unique_companies, count(DISTINCT job_location) AS unique_locations,
  count(DISTINCT job_title) AS unique_job_titles,
  {share(urls('posted_to_discord'), 'count(*)')} AS pct_discord_posted,
  {urls(REMOTE)} AS remote_jobs_count, {urls(HYBRID)} AS hybrid_jobs_count,
  {urls(FULLTIME)} AS fulltime_jobs_count, {urls(ONSITE)} AS onsite_jobs_count,
  {share(urls(BACHELOR), 'count(DISTINCT url)')} AS pct_bachelor_required, {mean()} AS avg_salary,
  {urls('salary_avg_million IS NOT NULL')} AS salaried_positions_count,
  min(job_posted_date) AS earliest_job_date, max(job_posted_date) AS latest_job_date
  FROM classified GROUP BY source_platform""")
def a8(spark, sf):
    return gold.platform_comparison(stored_fact(spark, sf))


@query("a9_salary_benchmark", sql.FACT + f"""SELECT {sql.key('salary_band')} AS salary_band_id, salary_band,
  count(*) AS num_positions, {urls('salary_avg_million IS NOT NULL')} AS salaried_positions,
  {mean()} AS avg_salary, quantile_cont(salary_avg_million, 0.25) AS salary_q1,
  quantile_cont(salary_avg_million, 0.5) AS salary_median, quantile_cont(salary_avg_million, 0.75) AS salary_q3,
  min(salary_min_million) AS min_salary, max(salary_max_million) AS max_salary,
  {urls(REMOTE)} AS remote_positions, {urls(HYBRID)} AS hybrid_positions, {urls(ONSITE)} AS on_site_positions
  FROM classified GROUP BY salary_band""")
def a9(spark, sf):
    return gold.salary_benchmark(stored_fact(spark, sf))


SUMMARY = f"""SELECT c.company_id,
  row_number() OVER (ORDER BY c.total_job_postings DESC, c.company_id) AS company_rank, c.company_name,
  c.source_platform, c.total_job_postings, c.num_locations, c.discord_postings, c.pct_discord_posted,
  CAST(date_diff('day', c.first_posting_date, DATE '{GOLD_DAY}') + 1 AS INTEGER) AS active_days_range,
  c.first_posting_date, c.last_posting_date, c.avg_salary_offered, j.unique_locations_hiring,
  j.unique_job_titles, c.work_models_offered
  FROM dim_company c JOIN (SELECT company_name, source_platform,
    count(DISTINCT job_location) AS unique_locations_hiring, count(DISTINCT job_title) AS unique_job_titles
    FROM classified GROUP BY company_name, source_platform) j
  ON c.company_name = j.company_name AND c.source_platform = j.source_platform"""
COMPANY_CTES = (*sql.FACT_CTES, f"dim_company AS ({DIM_COMPANY})")


def hiring_summary(spark, sf):
    rows = stored_fact(spark, sf)
    return gold.company_hiring_summary(
        dims.dim_company(rows), rows, F.lit(GOLD_DAY).cast("date")
    )


@query("a10_company_hiring_summary", with_(*COMPANY_CTES) + SUMMARY)
def a10(spark, sf):
    return hiring_summary(spark, sf)


@query("j4_company_fact_join", with_(*COMPANY_CTES) + """SELECT c.company_name, c.source_platform,
  c.total_job_postings, count(*) AS fact_rows FROM dim_company c LEFT JOIN fact j
  ON c.company_name = j.company_name AND c.source_platform = j.source_platform
  WHERE j.job_category <> 'Others' GROUP BY ALL""")
def j4(spark, sf):
    rows = stored_fact(spark, sf)
    keys = ["company_name", "source_platform"]
    offers = wh.classified(rows).groupBy(*keys).agg(F.count("*").alias("fact_rows"))
    companies = dims.dim_company(rows).select(*keys, "total_job_postings")
    return companies.join(offers, keys)


@query("w1_global_rank", with_(*COMPANY_CTES) + """SELECT company_id, total_job_postings,
  row_number() OVER (ORDER BY total_job_postings DESC, company_id NULLS LAST) AS company_rank FROM dim_company""")
def w1(spark, sf):
    from ..operators.measures import global_rank

    companies = dims.dim_company(stored_fact(spark, sf))
    ranked = global_rank(companies, "total_job_postings", "company_id", "company_rank")
    return ranked.select("company_id", "total_job_postings", "company_rank")


@query("w2_location_salary_analysis", with_(*sql.FACT_CTES, f"l AS ({DIM_LOCATION})") + f"""SELECT
  row_number() OVER (ORDER BY avg_salary_by_location DESC NULLS LAST, location_id NULLS LAST) AS salary_rank,
  location_id, job_location, total_jobs, num_companies, num_platforms,
  {share('total_jobs', '(SELECT count(*) FROM fact)')} AS pct_of_total_jobs, avg_salary_by_location,
  highest_salary, lowest_salary, remote_jobs, hybrid_jobs, onsite_jobs, fulltime_jobs,
  {share('remote_jobs', 'total_jobs')} AS pct_remote, {share('hybrid_jobs', 'total_jobs')} AS pct_hybrid,
  education_requirements FROM l""")
def w2(spark, sf):
    rows = stored_fact(spark, sf)
    return gold.location_salary_analysis(dims.dim_location(rows), rows)


@query("w3_education_distribution", with_(*sql.FACT_CTES, f"e AS ({DIM_EDUCATION})") + """SELECT e.*,
  row_number() OVER (ORDER BY job_count DESC, education_requirement) AS demand_rank,
  round(avg(avg_salary) OVER (), 1) AS market_avg_salary,
  avg_salary - round(avg(avg_salary) OVER (), 1) AS salary_vs_market,
  round((avg_salary - round(avg(avg_salary) OVER (), 1)) / round(avg(avg_salary) OVER (), 1) * 100, 2)
    AS salary_vs_market_pct FROM e""")
def w3_education(spark, sf):
    return gold.education_distribution(dims.dim_education(stored_fact(spark, sf)))


@query("w3_work_model_analysis", with_(*sql.FACT_CTES, f"w AS ({DIM_WORK_MODEL})") + """SELECT w.*,
  row_number() OVER (ORDER BY job_count DESC, work_model_normalized) AS demand_rank,
  round(avg(avg_salary) OVER (), 1) AS market_avg_salary,
  round(avg_salary - avg(avg_salary) OVER (), 1) AS salary_vs_market,
  CASE WHEN avg_salary > avg(avg_salary) OVER () THEN 'Above Average'
    WHEN avg_salary < avg(avg_salary) OVER () THEN 'Below Average' ELSE 'At Market' END AS salary_positioning
  FROM w""")
def w3_models(spark, sf):
    return gold.work_model_analysis(dims.dim_work_model(stored_fact(spark, sf)))


@query("j13_pct_of_total", sql.FACT + f"""SELECT salary_band, {share('count(*)', '(SELECT count(*) FROM fact)')} AS pct_of_all
  FROM fact GROUP BY salary_band""")
def j13(spark, sf):
    from ..operators.measures import share as percent
    from ..operators.measures import with_total

    rows = stored_fact(spark, sf)
    groups = rows.groupBy("salary_band").agg(F.count("*").alias("rows"))
    total = rows.agg(F.count("*").alias("total"))
    return with_total(groups, total).select(
        "salary_band", percent(F.col("rows"), F.col("total")).alias("pct_of_all")
    )


@query("a11_job_daily_snapshot", sql.FACT + """SELECT job_posted_date, source_platform, count(*) AS total_jobs
  FROM classified GROUP BY job_posted_date, source_platform""")
def a11(spark, sf):
    return gold.job_daily_snapshot(wh.job_fact(fact(spark, sf)))


@query("x3_distinct_rows", with_(sql.JOBS_SQL) + """SELECT DISTINCT md5(logo_url) AS logo_id,
  'logos/' || md5(logo_url) || '.png' AS logo_path FROM jobs_raw WHERE logo_url IS NOT NULL""")
def x3(spark, sf):
    urls_ = jobs_raw(spark, sf).filter(F.col("logo_url").isNotNull())
    stored = urls_.select(
        F.md5("logo_url").alias("logo_id"),
        F.concat(F.lit("logos/"), F.md5("logo_url"), F.lit(".png")).alias("logo_path"),
    )
    return dims.dim_company_logo(stored)
