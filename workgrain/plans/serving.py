"""Queries of search, dashboard and company pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import salary, text
from ..operators import active, companies, dashboard, search
from ..sources.tables import as_raw_jobs, scan_jobs
from . import sql
from .fixtures import AS_OF, as_of, documents, jobs_raw, table
from .registry import query
from .sql import JOBS, any_in, q, with_

CLEAN = with_(sql.JOBS_SQL, sql.CLEAN_SQL)
HANOI_OR = "(location ILIKE '%hà nội%' OR location ILIKE '%ha noi%')"
HCMC_OR = "(location ILIKE '%hồ chí minh%' OR location ILIKE '%ho chi minh%' OR location ILIKE '%hcm%')"


@query("s4_scan_jobs", JOBS + """SELECT id, title, company, location, salary AS raw_salary,
  experience AS raw_experience, source, crawled_at FROM jobs_raw""")
def s4(spark, sf):
    return scan_jobs(as_raw_jobs(jobs_raw(spark, sf)))


@query("p2_dim_jobs_clean", CLEAN + "SELECT * FROM clean")
def p2(spark, sf):
    clean = active.dim_jobs_clean(scan_jobs(jobs_raw(spark, sf)))
    return clean.withColumn("salary_numeric_extract", F.col("salary_numeric_extract").cast("string"))


@query("p2_clean_counts", CLEAN + """SELECT location_clean, experience_level, count(*) AS jobs FROM clean
  GROUP BY location_clean, experience_level""")
def p2_counts(spark, sf):
    return active.clean_counts(active.dim_jobs_clean(scan_jobs(jobs_raw(spark, sf))))


@query("p5_keyword_filter", JOBS + """SELECT id, title, company FROM jobs_raw
  WHERE title ILIKE '%engineer%' OR company ILIKE '%engineer%'""")
def p5(spark, sf):
    return search.keyword(jobs_raw(spark, sf), "engineer").select("id", "title", "company")


@query("p6_location_filter", JOBS + f"""SELECT 'hà nội' AS filter, id, location FROM jobs_raw WHERE {HANOI_OR}
  UNION ALL SELECT 'hồ chí minh', id, location FROM jobs_raw WHERE {HCMC_OR}
  UNION ALL SELECT 'other', id, location FROM jobs_raw WHERE NOT {HANOI_OR} AND NOT {HCMC_OR}""")
def p6(spark, sf):
    jobs = jobs_raw(spark, sf).select("id", "location")
    parts = [
        search.location(jobs, place).select(F.lit(place).alias("filter"), "id", "location")
        for place in ("hà nội", "hồ chí minh", "other")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p7_source_filter", JOBS + "SELECT id, source FROM jobs_raw WHERE source = 'itviec'")
def p7(spark, sf):
    return search.source(jobs_raw(spark, sf), "itviec").select("id", "source")


def jobs_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Postings whose order key carries one of the given vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    jobs = jobs_raw(spark, sf)
    return jobs.join(vectors, jobs.order_key == vectors.vec_id, "left").drop("vec_id")


def query_vector(spark: SparkSession, sf: str) -> list[float]:
    """The search parameter: the vector with id 0."""
    return table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


@query("p8_not_null_filters", JOBS + """SELECT count(*) AS jobs FROM jobs_raw LEFT JOIN embeddings
  ON vec_id = order_key WHERE url IS NOT NULL AND embedding IS NOT NULL""")
def p8(spark, sf):
    rows = search.has_vector(search.has_url(jobs_with_vectors(spark, sf)))
    return rows.agg(F.count("*").alias("jobs"))


@query("p9_recent", JOBS + f"""SELECT id, crawled_at FROM jobs_raw
  WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def p9(spark, sf):
    return search.recent(jobs_raw(spark, sf), as_of() - F.expr("INTERVAL 30 DAYS")).select("id", "crawled_at")


@query("p16_job_by_id", JOBS + """SELECT id, coalesce(nullif(title, ''), 'Chưa có tiêu đề') AS title,
  coalesce(nullif(company, ''), 'Không rõ công ty') AS company, coalesce(url, '') AS url, location, salary,
  CAST(NULL AS VARCHAR) AS logo_url, coalesce(source, 'unknown') AS source, CAST(NULL AS VARCHAR) AS category,
  experience, CAST(NULL AS VARCHAR) AS level, description, requirements, crawled_at AS created_at
  FROM jobs_raw WHERE id = 'job-97'""")
def p16(spark, sf):
    return search.job_by_id(jobs_raw(spark, sf), " job-97 ")


@query("f26_default_labels", JOBS + """SELECT id, coalesce(nullif(title, ''), 'Chưa có tiêu đề') AS title,
  coalesce(nullif(company, ''), 'Không rõ công ty') AS company, coalesce(url, '') AS url,
  coalesce(source, 'unknown') AS source FROM jobs_raw""")
def f26(spark, sf):
    return search.labelled(jobs_raw(spark, sf)).select("id", "title", "company", "url", "source")


@query("a14_totals", JOBS + """SELECT count(*) AS total_jobs,
  count(DISTINCT nullif(trim(company), '')) AS total_companies FROM jobs_raw""")
def a14(spark, sf):
    return dashboard.totals(jobs_raw(spark, sf))


@query("a15_jobs_by_source", JOBS + """SELECT CASE source WHEN 'itviec' THEN 'ITViec' WHEN 'linkedin' THEN 'LinkedIn'
  WHEN 'topcv' THEN 'TopCV' ELSE source END AS name, count(*) AS value FROM jobs_raw
  WHERE source IS NOT NULL GROUP BY source""")
def a15(spark, sf):
    return dashboard.jobs_by_source(jobs_raw(spark, sf))


@query("a16_jobs_by_city", JOBS + f"""SELECT CASE WHEN {any_in('location', 'hà nội', 'ha noi')} THEN 'Hà Nội'
  WHEN {any_in('location', 'hồ chí minh', 'ho chi minh', 'hcm')} THEN 'Hồ Chí Minh' ELSE 'Khác' END AS name,
  count(*) AS value FROM jobs_raw WHERE location IS NOT NULL GROUP BY 1""")
def a16(spark, sf):
    return dashboard.jobs_by_city(jobs_raw(spark, sf))


@query("a17_top_companies", JOBS + """SELECT company AS name, count(*) AS jobs FROM jobs_raw
  WHERE company IS NOT NULL GROUP BY company ORDER BY jobs DESC, name LIMIT 10""")
def a17(spark, sf):
    return dashboard.top_companies(jobs_raw(spark, sf))


@query("a18_daily_trend", JOBS + """SELECT day, strftime(day, '%d/%m') AS date, jobs FROM (
  SELECT CAST(crawled_at AS DATE) AS day, count(*) AS jobs FROM jobs_raw WHERE crawled_at IS NOT NULL
  GROUP BY 1 ORDER BY 1 DESC LIMIT 14) ORDER BY day""")
def a18(spark, sf):
    return dashboard.daily_trend(jobs_raw(spark, sf))


PAID = with_(sql.JOBS_SQL, *sql.pay_ctes("jobs_raw"))
FALLBACK = "coalesce(pay_value, pay_min, pay_max)"
RATE = "CASE WHEN pay_currency = 'USD' THEN 25000.0 ELSE 1.0 END"


@query("a19_salary_histogram", with_(sql.JOBS_SQL, *sql.pay_ctes("jobs_raw"),
       f"""means AS (SELECT (coalesce(pay_min, {FALLBACK}) * {RATE} / 1000000
  + coalesce(pay_max, {FALLBACK}) * {RATE} / 1000000) / 2 AS mean FROM paid
  WHERE salary NOT IN ('', 'Thoả thuận', 'Thỏa thuận'))""") + """SELECT '< 10 Triệu' AS name,
  count(*) FILTER (mean < 10) AS jobs FROM means
  UNION ALL SELECT '10 - 20 Triệu', count(*) FILTER (mean >= 10 AND mean <= 20) FROM means
  UNION ALL SELECT '20 - 40 Triệu', count(*) FILTER (mean > 20 AND mean <= 40) FROM means
  UNION ALL SELECT '> 40 Triệu', count(*) FILTER (mean > 40) FROM means""")
def a19(spark, sf):
    return dashboard.salary_histogram(jobs_raw(spark, sf))


@query("f11_salary_struct", PAID + """SELECT id, salary, pay_currency, pay_min, pay_max, pay_value FROM paid""")
def f11(spark, sf):
    pay = salary.parse_salary(F.col("salary"))
    rows = jobs_raw(spark, sf).select("id", "salary", pay.alias("pay"))
    return rows.select(
        "id", "salary", F.col("pay.currency").alias("pay_currency"), F.col("pay.min").alias("pay_min"),
        F.col("pay.max").alias("pay_max"), F.col("pay.value").alias("pay_value"),
    )


@query("a23_match_total", JOBS + f"""SELECT count(*) AS total FROM jobs_raw WHERE url IS NOT NULL
  AND (title ILIKE '%data%' OR company ILIKE '%data%') AND {HANOI_OR} AND source = 'topcv'""")
def a23(spark, sf):
    return search.match_total(search.filtered(jobs_raw(spark, sf), "data", "hà nội", "topcv"))


@query("o1_newest_page", JOBS + """SELECT id, crawled_at FROM jobs_raw
  ORDER BY crawled_at DESC NULLS LAST, id LIMIT 20 OFFSET 20""")
def o1(spark, sf):
    return search.newest_page(jobs_raw(spark, sf).select("id", "crawled_at"), page=2)


COSINE = """list_cosine_similarity(CAST(embedding AS DOUBLE[]),
  (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"""


@query("v2_cosine_knn", f"""SELECT vec_id, round({COSINE}, 6) AS similarity FROM embeddings
  ORDER BY {COSINE} DESC, vec_id LIMIT 20""")
def v2(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = search.knn(rows, query_vector(spark, sf), ident="vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("v2_knn_by_groups", f"""SELECT vec_id, round({COSINE}, 6) AS similarity FROM embeddings
  ORDER BY {COSINE} DESC, vec_id LIMIT 20""")
def v2_groups(spark, sf):
    """The same rows from vectors stored in groups, of which only those are read that could hold one of them."""
    from ..operators.vector_groups import VectorGroups
    from ..session import scratch_dir

    stored = VectorGroups(spark, scratch_dir(spark, "vector-groups"), ident="vec_id")
    query = query_vector(spark, sf)
    stored.build(table(spark, sf, "embeddings").select("vec_id", "embedding"), len(query))
    found, _ = stored.nearest(query, 20)
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("o2_knn_page", f"""SELECT vec_id, round({COSINE}, 6) AS similarity FROM embeddings
  ORDER BY {COSINE} DESC, vec_id LIMIT 20 OFFSET 40""")
def o2(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    found = search.knn(rows, query_vector(spark, sf), offset=40, ident="vec_id")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


CV = "Python and SQL Server developer, docker, kafka, some java"
JOB_TEXT = "lower(coalesce(requirements, '') || ' ' || coalesce(description, ''))"


def _gap_ctes(source: str) -> str:
    return f"""gaps AS (SELECT *, list_filter(job_skills, lambda s: list_contains(cv_skills, s)) AS hit,
  list_filter(job_skills, lambda s: NOT list_contains(cv_skills, s)) AS miss FROM (
  SELECT *, {sql.skills(q(CV.lower()))} AS cv_skills, {sql.skills(JOB_TEXT)} AS job_skills FROM {source}))"""


GAP_ITEMS = """array_to_string(hit, ',') AS matched_skills, array_to_string(miss, ',') AS missing_skills,
  CASE WHEN len(job_skills) > 0 THEN CAST(floor(len(hit) * 100.0 / len(job_skills) + 0.5) AS INTEGER) END AS match_percentage"""


@query("v3_cv_match", with_(sql.JOBS_SQL, f"""page AS (SELECT j.*, {COSINE} AS similarity FROM jobs_raw j
  JOIN embeddings e ON vec_id = order_key WHERE url IS NOT NULL AND (title ILIKE '%engineer%' OR company ILIKE '%engineer%')
  ORDER BY similarity DESC, id LIMIT 20)""", _gap_ctes("page")) + f"""SELECT id,
  coalesce(nullif(title, ''), 'Chưa có tiêu đề') AS title, coalesce(nullif(company, ''), 'Không rõ công ty') AS company,
  location, salary, experience, description, requirements, coalesce(url, '') AS url, source, crawled_at,
  round(similarity, 6) AS similarity, {GAP_ITEMS} FROM gaps""")
def v3(spark, sf):
    found = search.match(jobs_with_vectors(spark, sf), CV, query_vector(spark, sf), word="engineer")
    return found.withColumns({
        "similarity": F.round("similarity", 6),
        "matched_skills": F.array_join("matched_skills", ","),
        "missing_skills": F.array_join("missing_skills", ","),
    })


@query("v3_match_without_cv", with_(sql.JOBS_SQL, f"""page AS (SELECT * FROM jobs_raw WHERE url IS NOT NULL
  AND {HCMC_OR} ORDER BY crawled_at DESC NULLS LAST, id LIMIT 20)""") + """SELECT id, crawled_at,
  CAST(1 AS DOUBLE) AS similarity FROM page""")
def v3_plain(spark, sf):
    found = search.match(jobs_raw(spark, sf), place="hồ chí minh")
    return found.select("id", "crawled_at", "similarity")


@query("f27_skills_documents", f"""SELECT doc_id, array_to_string({sql.skills('lower(text)')}, ',') AS skills
  FROM documents""")
def f27(spark, sf):
    from ..functions.skills import extract_skills

    rows = documents(spark, sf)
    return rows.select("doc_id", F.array_join(extract_skills(F.col("text")), ",").alias("skills"))


@query("f28_skill_gap", with_(sql.JOBS_SQL, _gap_ctes("jobs_raw")) + f"SELECT id, {GAP_ITEMS} FROM gaps")
def f28(spark, sf):
    from ..functions.skills import extract_skills, skill_gap

    job_text = F.concat_ws(" ", F.coalesce("requirements", F.lit("")), F.coalesce("description", F.lit("")))
    gap = skill_gap(extract_skills(F.lit(CV)), extract_skills(job_text))
    rows = jobs_raw(spark, sf).select("id", gap.alias("gap"))
    return rows.select(
        "id", F.array_join("gap.matched", ",").alias("matched_skills"),
        F.array_join("gap.missing", ",").alias("missing_skills"),
        F.col("gap.percentage").alias("match_percentage"),
    )


@query("o3_missing_vectors", JOBS + """SELECT id, crawled_at FROM jobs_raw LEFT JOIN embeddings ON vec_id = order_key
  WHERE embedding IS NULL ORDER BY crawled_at, id LIMIT 500""")
def o3(spark, sf):
    return search.missing_vectors(jobs_with_vectors(spark, sf)).select("id", "crawled_at")


@query("o4_sitemap_jobs", JOBS + f"""SELECT id, crawled_at FROM jobs_raw
  WHERE crawled_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY ORDER BY crawled_at DESC, id""")
def o4(spark, sf):
    return search.sitemap_jobs(jobs_raw(spark, sf), as_of())


@query("o5_digest_candidates", JOBS + f"""SELECT id, crawled_at FROM jobs_raw
  WHERE crawled_at > TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY ORDER BY crawled_at, id""")
def o5(spark, sf):
    return search.digest_candidates(jobs_raw(spark, sf), as_of() - F.expr("INTERVAL 1000 DAYS"))


@query("v1_encode_documents")
def v1(spark, sf):
    rows = documents(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    vectors = search.encode(rows, F.col("text")).select("doc_id", "embedding")
    norm = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    return vectors.select("doc_id", F.size("embedding").alias("size"), F.round(F.sqrt(norm), 4).alias("norm"))


@query("v4_backfill_vectors", JOBS + """SELECT embedding IS NOT NULL OR place <= 100 AS has_vector, count(*) AS jobs
  FROM (SELECT *, row_number() OVER (PARTITION BY embedding IS NULL ORDER BY crawled_at, id) AS place
  FROM jobs_raw LEFT JOIN embeddings ON vec_id = order_key) GROUP BY 1""")
def v4(spark, sf):
    from ..functions.posting import embedding_text

    fields = [F.col(c) for c in ("title", "experience", "description", "requirements")]
    target = jobs_with_vectors(spark, sf)
    filled = search.backfill(target, embedding_text(*fields), limit=100)
    return filled.groupBy(F.col("embedding").isNotNull().alias("has_vector")).agg(F.count("*").alias("jobs"))


NAMED = f"""counts AS (SELECT company, count(*) AS job_count, max(crawled_at) AS latest, {sql.SLUG} AS slug
  FROM jobs_raw WHERE trim(company) <> '' GROUP BY company),
directory AS (SELECT company, slug, job_count, latest FROM (SELECT *,
  row_number() OVER (PARTITION BY slug ORDER BY job_count DESC, company) AS place FROM counts WHERE slug <> '')
  WHERE place = 1)"""
DIRECTORY = with_(sql.JOBS_SQL, NAMED)


@query("a20_company_directory", DIRECTORY + "SELECT * FROM directory")
def a20(spark, sf):
    return companies.directory(jobs_raw(spark, sf))


@query("w5_best_per_slug", with_(sql.JOBS_SQL, NAMED) + """SELECT slug, max(job_count) AS job_count FROM counts
  WHERE slug <> '' GROUP BY slug""")
def w5(spark, sf):
    return companies.directory(jobs_raw(spark, sf)).select("slug", "job_count")


@query("f9_slug", JOBS + f"SELECT DISTINCT company, {sql.SLUG} AS slug FROM jobs_raw")
def f9(spark, sf):
    return jobs_raw(spark, sf).select("company", text.slug(F.col("company")).alias("slug")).distinct()


@query("p15_directory_search", DIRECTORY + "SELECT company, slug FROM directory WHERE contains(lower(company), '#00000012')")
def p15(spark, sf):
    return companies.search_companies(companies.directory(jobs_raw(spark, sf)), " #00000012 ").select("company", "slug")


@query("p18_indexable_companies", DIRECTORY + "SELECT slug, latest FROM directory WHERE job_count >= 2")
def p18(spark, sf):
    return companies.indexable(companies.directory(jobs_raw(spark, sf))).select("slug", "latest")


@query("o6_multi_key_order", DIRECTORY + """SELECT company, job_count FROM directory
  ORDER BY job_count DESC, company LIMIT 20 OFFSET 20""")
def o6(spark, sf):
    return companies.directory_page(companies.directory(jobs_raw(spark, sf)), 2).select("company", "job_count")


@query("j12_company_by_slug", DIRECTORY + """SELECT id, j.company, crawled_at FROM jobs_raw j JOIN directory d
  ON j.company = d.company WHERE d.slug = 'customer-000000016-da-nang'""")
def j12(spark, sf):
    jobs = jobs_raw(spark, sf)
    found = companies.company_by_slug(companies.directory(jobs), jobs, "customer-000000016-da-nang")
    return found.select("id", "company", "crawled_at")


FACET = """SELECT company, value, count, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY company
  ORDER BY count DESC, value) AS INTEGER) AS place FROM (SELECT company, {col} AS value, count(*) AS count
  FROM jobs_raw WHERE coalesce({col}, '') <> '' AND company IS NOT NULL GROUP BY ALL)) WHERE place <= {k}"""


@query("a21_company_facets", JOBS + FACET.format(col="location", k=8))
def a21(spark, sf):
    return companies.facets(jobs_raw(spark, sf), "location").select("company", "value", "count", "place")


@query("w6_top_k_per_group", JOBS + FACET.format(col="salary", k=3))
def w6(spark, sf):
    return companies.facets(jobs_raw(spark, sf), "salary", 3).select("company", "value", "count", "place")


def _shown(col: str) -> str:
    return (
        f"CASE WHEN {col} = floor({col}) THEN CAST(CAST({col} AS BIGINT) AS VARCHAR)"
        f" ELSE printf('%.1f', {col}) END"
    )


RANGES = """bounds AS (SELECT company, min(least(pay_min, pay_max, pay_value)) / 1000000 AS low,
  max(greatest(pay_min, pay_max, pay_value)) / 1000000 AS high FROM paid
  WHERE pay_currency = 'VND' AND company IS NOT NULL GROUP BY company)"""
RANGE_TEXT = f"""CASE WHEN low = high THEN {_shown('low')} || ' triệu'
  ELSE {_shown('low')} || ' – ' || {_shown('high')} || ' triệu' END"""


@query("a22_company_salary_range", with_(sql.JOBS_SQL, *sql.pay_ctes("jobs_raw"), RANGES)
       + f"SELECT company, {RANGE_TEXT} AS salary_range FROM bounds")
def a22(spark, sf):
    return companies.salary_ranges(jobs_raw(spark, sf))


@query("j12_company_detail", with_(sql.JOBS_SQL, NAMED, *sql.pay_ctes("jobs_raw"), RANGES) + f"""SELECT d.company, slug,
  job_count, coalesce(n, 0) AS location_facets, {RANGE_TEXT} AS salary_range FROM directory d
  LEFT JOIN (SELECT company, CAST(least(count(DISTINCT location), 8) AS INTEGER) AS n FROM jobs_raw
    WHERE coalesce(location, '') <> '' GROUP BY company) f ON f.company = d.company
  LEFT JOIN bounds b ON b.company = d.company""")
def detail(spark, sf):
    jobs = jobs_raw(spark, sf)
    rows = companies.company_detail(companies.directory(jobs), jobs)
    count = F.coalesce(F.size("locations"), F.lit(0))
    return rows.select(
        "company", "slug", "job_count",
        F.when(count < 0, 0).otherwise(count).alias("location_facets"), "salary_range",
    )
