"""Queries of page extraction, sources and sinks.

Besides the given pages, some queries read pages that Spark renders from the
postings in the layouts of the boards, so that extraction can be checked against
the fields the pages were made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import active, pages, state
from ..operators import warehouse as wh
from ..schemas import STAGING_TOPCV
from ..session import scratch_dir
from ..sources import batches, seeds, tables
from ..sources import pages as archive
from . import sql
from .fixtures import jobs_raw, page_tasks, staging_itviec, staging_topcv, table
from .fixtures import pages as given_pages
from .registry import query
from .serving import CLEAN
from .sql import JOBS, with_

BASE = "https://jobs.example"
OWN = pages.Spec(
    texts={"title": ("h1",), "company": ("div.ad",), "description": ("article",)},
    lists={"links": "nav a", "bold": "article b"},
)


def safe(c: str) -> F.Column:
    """Text as page content, empty for null."""
    escaped = F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(escaped, F.lit("<"), F.lit("&lt;"))


def html(template: str, **values: F.Column) -> F.Column:
    """Fills ``{name}`` places of a page template."""
    parts = []
    for piece in template.split("{"):
        name, _, rest = piece.partition("}") if "}" in piece else ("", "", piece)
        if name:
            parts.append(values[name])
        parts.append(F.lit(rest))
    return F.concat(*parts)


SECTION = """<div class="job-detail__info--section"><div class="job-detail__info--section-content-title">{label}</div>
<div class="job-detail__info--section-content-value">{value}</div></div>"""
ITEM = """<div class="job-description__item"><h3>{label}</h3><div class="job-description__item--content">{value}</div></div>"""


def fill(template: str, label: str, name: str) -> str:
    return template.replace("{label}", label).replace("{value}", "{" + name + "}")


DETAIL = (
    '<html><body><h1 class="job-detail__info--title"> {title} </h1><a class="company company-name" href="/cong-ty/{id}">{company}</a>'
    + fill(SECTION, "MỨC LƯƠNG", "salary") + fill(SECTION, "Địa điểm", "location")
    + fill(SECTION, "Kinh nghiệm", "experience")
    + '<div class="job-detail__info--deadline">Hạn nộp hồ sơ: {day}</div><div class="job-description">'
    + fill(ITEM, "Mô tả công việc", "id") + fill(ITEM, "Mô tả công việc", "description")
    + fill(ITEM, "Yêu cầu ứng viên", "requirements")
    + ITEM.replace("{label}", "Địa điểm làm việc").replace("{value}", "<div>{location}</div><ul><li></li><li>{company}</li></ul>")
    + '</div><div class="job-tags"><a class="item">data</a><a class="item"> </a><a class="item">remote</a></div>'
    '<script>var x = "</p>";</script></body></html>'
)


def detail_pages(jobs: DataFrame, *kept: str) -> DataFrame:
    names = ("title", "company", "salary", "location", "experience", "description", "requirements", "id")
    page = html(DETAIL, **{n: safe(n) for n in names}, day=F.date_format("crawled_at", "d/M/yyyy"))
    return jobs.select(F.col("id").alias("page_id"), "crawled_at", *kept, page.alias("html"))


def squeezed(col: str) -> str:
    return f"coalesce(trim(regexp_replace({col}, '\\s+', ' ', 'g')), '')"


def topcv_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """Postings of one board, dealt for page work."""
    return jobs_raw(spark, sf).filter("source = 'topcv'").repartition(page_tasks(spark, sf), "id")


def absolute() -> str:
    return f"string_split('{BASE}' || href, '?')[1]"


@query("h1_discover_links", f"""SELECT DISTINCT {absolute()} AS url FROM (SELECT
  unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), 'href="([^"]*)"', 1)) AS href FROM pages)""")
def h1(spark, sf):
    return pages.discover_links(given_pages(spark, sf), "nav a[href]", BASE)


PLAIN = """replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&')"""


@query("h2_extract_records", f"""SELECT page_id, trim(regexp_replace({PLAIN.format("regexp_extract(html, '<h1>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')) AS title,
  trim(regexp_replace({PLAIN.format("regexp_extract(html, '<div class=.ad.>((?s:.*?))</div>', 1)")}, '\\s+', ' ', 'g')) AS company,
  md5(trim(regexp_replace({PLAIN.format("regexp_replace(regexp_extract(html, '<article>((?s:.*))</article>', 1), '<[^>]*>', ' ', 'g')")}, '\\s+', ' ', 'g'))) AS description
  FROM pages""")
def h2(spark, sf):
    parsed = pages.parse(given_pages(spark, sf).select("page_id", "html"), OWN)
    return parsed.select(
        "page_id", pages.text("title").alias("title"), pages.text("company").alias("company"),
        F.md5(pages.text("description")).alias("description"),
    )


@query("h2_board_records", JOBS + f"""SELECT id, {squeezed('title')} AS title, {squeezed('company')} AS company,
  {squeezed('location')} AS location, {squeezed('salary')} AS salary, {squeezed('description')} AS description,
  {squeezed('requirements')} AS requirements, {squeezed('experience')} AS experience, 'data, remote' AS tags,
  'topcv' AS source, 'https://www.topcv.vn/viec-lam/' || id || '.html' AS url, crawled_at,
  CAST(NULL AS VARCHAR) AS parse_error FROM jobs_raw WHERE source = 'topcv'""")
def h2_board(spark, sf):
    rendered = detail_pages(topcv_jobs(spark, sf))
    found = pages.extract_records(rendered, "topcv", F.lit(None).cast("timestamp_ntz"))
    times = jobs_raw(spark, sf).filter("source = 'topcv'").select("id", "crawled_at")
    return found.drop("crawled_at").join(times, "id").select(*found.columns)


ITVIEC_PAGE = """<html><body><h1>{title}</h1><div class="employer-info__name">{company}</div><span class="location">{location}</span>
<span class="salary">{salary}</span><div class="job-description">{description}</div><section class="job-requirements">{requirements}</section>
<div class="job-tags"><a class="tag">data</a><a class="tag"></a><a class="tag">remote</a></div></body></html>"""
LINKEDIN_PAGE = """<html><body><h1 class="top-card-layout__title">{title}</h1><a class="topcard__org-name-link">{company}</a>
<span class="topcard__flavor--bullet">{location}</span><div class="description__text">{description}<p>{requirements}</p></div></body></html>"""


def board_records(spark: SparkSession, sf: str, source: str, template: str) -> DataFrame:
    """Records read back from pages in a board's layout, beside the time of the posting."""
    names = ("title", "company", "salary", "location", "description", "requirements")
    jobs = jobs_raw(spark, sf).filter(F.col("source") == source)
    rendered = jobs.repartition(page_tasks(spark, sf), "id").select(
        F.concat(F.lit(f"{source}_"), "id").alias("page_id"), html(template, **{n: safe(n) for n in names}).alias("html")
    )
    found = pages.extract_records(rendered, source, F.lit(None).cast("timestamp_ntz"))
    times = jobs.select(F.concat(F.lit(f"{source}_"), "id").alias("id"), "crawled_at")
    return found.drop("crawled_at").join(times, "id").select(*found.columns)


@query("h2_itviec_records", JOBS + f"""SELECT 'itviec_' || id AS id, {squeezed('title')} AS title, {squeezed('company')} AS company,
  {squeezed('location')} AS location, {squeezed('salary')} AS salary, {squeezed('description')} AS description,
  {squeezed('requirements')} AS requirements, '' AS experience, 'data, remote' AS tags, 'itviec' AS source,
  'https://itviec.com/it-jobs/' || id AS url, crawled_at, CAST(NULL AS VARCHAR) AS parse_error FROM jobs_raw WHERE source = 'itviec'""")
def h2_itviec(spark, sf):
    return board_records(spark, sf, "itviec", ITVIEC_PAGE)


@query("h2_linkedin_records", JOBS + f"""SELECT 'linkedin_' || id AS id, {squeezed('title')} AS title, {squeezed('company')} AS company,
  {squeezed('location')} AS location, '' AS salary,
  trim(concat_ws(' ', {squeezed('description')}, {squeezed('requirements')})) AS description, '' AS requirements, '' AS experience,
  '' AS tags, 'linkedin' AS source, 'https://www.linkedin.com/jobs/view/' || id AS url, crawled_at,
  CAST(NULL AS VARCHAR) AS parse_error FROM jobs_raw WHERE source = 'linkedin'""")
def h2_linkedin(spark, sf):
    return board_records(spark, sf, "linkedin", LINKEDIN_PAGE)


@query("h3_label_sections", JOBS + f"""SELECT id AS page_id, {squeezed('salary')} AS salary, {squeezed('location')} AS location,
  '' AS absent FROM jobs_raw WHERE source = 'topcv'""")
def h3(spark, sf):
    parsed = pages.parse(detail_pages(topcv_jobs(spark, sf)).select("page_id", "html"), pages.TOPCV_DETAIL)
    return parsed.select(
        "page_id", pages.info("mức lương").alias("salary"), pages.info("Địa điểm").alias("location"),
        pages.info("Cấp bậc").alias("absent"),
    )


@query("h4_heading_blocks", JOBS + f"""SELECT id AS page_id, {squeezed('description')} AS description,
  CAST(3 AS INTEGER) AS headings FROM jobs_raw WHERE source = 'topcv'""")
def h4(spark, sf):
    parsed = pages.parse(detail_pages(topcv_jobs(spark, sf)).select("page_id", "html"), pages.TOPCV_DETAIL)
    mapped = parsed.select("page_id", pages.block_map().alias("blocks"))
    return mapped.select(
        "page_id", F.element_at("blocks", F.lit("Mô tả công việc")).alias("description"),
        F.size("blocks").alias("headings"),
    )


@query("h5_repeated_elements", """SELECT page_id, array_to_string(list_filter(list_transform(
  regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), lambda t: trim(t)),
  lambda t: t <> ''), ', ') AS links FROM pages""")
def h5(spark, sf):
    parsed = pages.parse(given_pages(spark, sf).select("page_id", "html"), OWN)
    return parsed.select("page_id", pages.joined("links", ", ").alias("links"))


BRAND = """<div class="premium-job-description__box"><h2 class="premium-job-description__box--title">Mô tả công việc</h2>
<div class="premium-job-description__box--content">{description}</div></div><div class="box-info"><h2 class="title">Yêu cầu ứng viên</h2>
<div class="content-tab">{requirements}</div></div><div class="box-item"><strong>Học vấn</strong><span>{experience}</span></div>
<div class="general-information-data"><div class="general-information-data__label">Hình thức làm việc</div>
<div class="general-information-data__value">{work_arrangement}</div></div>"""
STANDARD = fill(ITEM, "Mô tả công việc", "description") + fill(ITEM, "Yêu cầu ứng viên", "requirements") + """
<div class="box-general-group-info"><div class="box-general-group-info-title">Học vấn</div>
<div class="box-general-group-info-value">{experience}</div></div><div class="box-general-group-info">
<div class="box-general-group-info-title">Hình thức làm việc</div><div class="box-general-group-info-value">{work_arrangement}</div></div>"""
NAMES7 = ("description", "requirements", "experience", "work_arrangement")
FORM = "CASE order_key % 3 WHEN 0 THEN 'brand' WHEN 1 THEN 'viec-lam' ELSE 'other' END"


def known(col: str, test: str = "order_key % 3 <> 2") -> str:
    return f"CASE WHEN {test} THEN nullif({squeezed(col)}, '') END"


@query("h7_two_templates", JOBS + f"""SELECT id, {known('description')} AS descriptions, {known('requirements')} AS requirements,
  {known('experience')} AS education, {known('work_arrangement')} AS type_of_work FROM jobs_raw""")
def h7(spark, sf):
    values = {n: safe(n) for n in NAMES7}
    page = F.when(F.col("order_key") % 3 == 0, html(BRAND, **values)).otherwise(html(STANDARD, **values))
    url = F.concat(F.lit("https://www.topcv.vn/"), F.expr(FORM), F.lit("/"), F.col("id"))
    jobs = jobs_raw(spark, sf).repartition(page_tasks(spark, sf), "id")
    rendered = jobs.select("id", url.alias("url"), page.alias("html"))
    return pages.extract_by_template(rendered).drop("url", "parse_error")


CARD = """<div class="job-item-search-result"><h3 class="title"><a href="{url}">{title}</a></h3>
<a class="company" href="/cong-ty/{id}"><span class="company-name">{company}</span></a><label class="title-salary">{salary}</label>
<label class="address"><span class="city-text">{location}</span></label><label class="exp"><span>{experience}</span></label></div>"""


def list_pages(jobs: DataFrame, tasks: int) -> DataFrame:
    """Twenty cards per list page, dealt by page."""
    names = ("url", "title", "id", "company", "salary", "location", "experience")
    paged = jobs.withColumn("page_id", F.floor(F.col("order_key") / 60)).repartition(tasks, "page_id")
    card = paged.select("page_id", "order_key", html(CARD, **{n: safe(n) for n in names}).alias("card"))
    cards = F.array_sort(F.collect_list(F.struct("order_key", "card")))
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n")
    grouped = card.groupBy("page_id").agg(cards.alias("cards"))
    return grouped.select("page_id", F.concat(F.lit("<main>"), body, F.lit("</main>")).alias("html"))


def listed(spark: SparkSession, sf: str) -> DataFrame:
    return list_pages(jobs_raw(spark, sf).filter("source = 'topcv'"), page_tasks(spark, sf))


def opt(col: str) -> str:
    return f"nullif({squeezed(col)}, '')"


@query("h8_list_cards", JOBS + f"""SELECT order_key // 60 AS page_id, {opt('title')} AS title, {opt('company')} AS company,
  {opt('salary')} AS salary_list, {opt('location')} AS address_list, {opt('experience')} AS exp_list, url AS job_url,
  'https://www.topcv.vn/cong-ty/' || id AS company_url FROM jobs_raw WHERE source = 'topcv' AND url IS NOT NULL""")
def h8(spark, sf):
    return pages.extract_cards(listed(spark, sf), pages.TOPCV_CARDS).drop("card")


PROFILE = """<html><head><title>{company} | TopCV tuyển dụng</title></head><body><div class="company-overview"><ul>
<li><strong>Website</strong>: https://x.example/{id}</li><li><b>Quy mô:</b> {size} nhân viên</li><li>Lĩnh vực: {industry}</li>
<li>Địa chỉ: cũ</li><li>Địa chỉ: {location}</li></ul></div><div class="company-description">{description}</div></body></html>"""


def profile_pages(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(
        F.col("c_name").alias("company"), F.col("c_custkey").cast("string").alias("id"),
        F.col("c_nationkey").cast("string").alias("size"), F.col("c_mktsegment").alias("industry"),
    )
    page = html(
        PROFILE, company=safe("company"), id=safe("id"), size=safe("size"), industry=safe("industry"),
        location=F.lit("Hà Nội"), description=safe("industry"),
    )
    return customers.select(F.concat(F.lit("https://www.topcv.vn/cong-ty/job-"), "id").alias("url"), page.alias("html"))


@query("h9_company_profile", """SELECT 'https://www.topcv.vn/cong-ty/job-' || c_custkey AS url, c_name AS company_name_full,
  'https://x.example/' || c_custkey AS company_website, c_nationkey || ' nhân viên' AS company_size,
  c_mktsegment AS company_industry, 'Hà Nội' AS company_address, c_mktsegment AS company_description FROM customer""")
def h9(spark, sf):
    return pages.extract_company(profile_pages(spark, sf)).drop("parse_error")


@query("h10_deadline", JOBS + """SELECT id AS page_id, strftime(crawled_at, '%-d/%-m/%Y') AS deadline,
  'Hạn nộp: sớm' AS plain FROM jobs_raw WHERE source = 'topcv'""")
def h10(spark, sf):
    parsed = pages.parse(detail_pages(topcv_jobs(spark, sf)).select("page_id", "html"), pages.TOPCV_DETAIL)
    return parsed.select(
        "page_id", pages.deadline(pages.deadline_line()).alias("deadline"),
        pages.deadline(F.lit("Hạn nộp: sớm")).alias("plain"),
    )


@query("h11_assemble", JOBS + f"""SELECT {opt('title')} AS title, {opt('title')} AS detail_title, url AS job_url,
  {opt('company')} AS company, c_name AS company_name_full, 'https://www.topcv.vn/cong-ty/' || id AS company_url,
  'https://www.topcv.vn/cong-ty/' || id AS company_url_from_job, {opt('salary')} AS salary_list, {opt('salary')} AS detail_salary,
  {opt('location')} AS address_list, {opt('location')} AS detail_location, {opt('experience')} AS exp_list,
  {opt('experience')} AS detail_experience, strftime(crawled_at, '%-d/%-m/%Y') AS deadline, 'data; remote' AS tags,
  nullif(concat_ws('; ', {opt('location')}, {opt('company')}), '') AS working_addresses,
  CAST(NULL AS VARCHAR) AS working_times, {opt('description')} AS desc_mota, {opt('requirements')} AS desc_yeucau,
  CAST(NULL AS VARCHAR) AS desc_quyenloi, 'https://x.example/' || c_custkey AS company_website,
  c_nationkey || ' nhân viên' AS company_size, c_mktsegment AS company_industry,
  CASE WHEN c_custkey IS NOT NULL THEN 'Hà Nội' END AS company_address, c_mktsegment AS company_description
  FROM jobs_raw LEFT JOIN customer ON c_custkey = order_key WHERE source = 'topcv' AND url IS NOT NULL""")
def h11(spark, sf):
    """Every list page is there twice; the second copies drop out by url path."""
    jobs = topcv_jobs(spark, sf)
    copies = F.explode(F.array(F.lit(0), F.lit(10_000_000)))
    twice = listed(spark, sf).withColumn("copy", copies).withColumn("page_id", F.col("page_id") + F.col("copy")).drop("copy")
    cards = pages.extract_cards(twice, pages.TOPCV_CARDS)
    details = pages.extract_details(detail_pages(jobs.filter("url IS NOT NULL"), "url"))
    return pages.assemble(cards, details, pages.extract_company(profile_pages(spark, sf)))


@query("h12_required_fields", JOBS + """SELECT id FROM jobs_raw WHERE coalesce(url, '') <> '' AND coalesce(requirements, '') <> ''
  AND coalesce(description, '') <> '' AND coalesce(experience, '') <> ''""")
def h12(spark, sf):
    return pages.require(jobs_raw(spark, sf), ["url", "requirements", "description", "experience"]).select("id")


@query("h13_bad_pages", """SELECT page_id % 10 <> 0 AS readable, count(*) AS pages FROM pages GROUP BY 1""")
def h13(spark, sf):
    """Every tenth page is empty: reported, while the others are read."""
    rows = given_pages(spark, sf).withColumn("html", F.when(F.col("page_id") % 10 != 0, F.col("html")))
    good, bad = pages.split_errors(pages.parse(rows.select("page_id", "html"), OWN))
    parts = good.select(F.lit(True).alias("readable")).unionByName(bad.select(F.lit(False).alias("readable")))
    return parts.groupBy("readable").agg(F.count("*").alias("pages"))


@query("h15_clean_markup", """SELECT page_id, contains(html, '<article') AS had_article, false AS has_script,
  false AS has_article FROM pages""")
def h15(spark, sf):
    rows = pages.sanitize_html(given_pages(spark, sf).withColumn("clean", F.col("html")), "clean")
    return rows.select(
        "page_id", F.col("html").contains("<article").alias("had_article"),
        F.col("clean").rlike("<script|<style").alias("has_script"),
        F.col("clean").contains("<article").alias("has_article"),
    )


# ---- sources and sinks ----


def archived(spark: SparkSession, sf: str) -> str:
    """The given pages packed into an archive of three sources and ten days."""
    root = scratch_dir(spark, "page-archive")
    rows = given_pages(spark, sf).selectExpr(
        "page_id", "html", "CASE page_id % 3 WHEN 0 THEN 'topcv' WHEN 1 THEN 'itviec' ELSE 'linkedin' END AS source",
        "'job_details' AS kind", "date_add(DATE '2024-01-01', CAST(page_id % 10 AS INT)) AS crawl_date",
    )
    archive.write_pages(rows, root)
    return root


@query("s1_page_archive_scan", """SELECT page_id, md5(html) AS html_md5 FROM pages
  WHERE page_id % 3 = 1 AND page_id % 10 = 4""")
def s1(spark, sf):
    rows = archive.scan_pages(spark, archived(spark, sf), "itviec", "job_details", "2024-01-05")
    return rows.select("page_id", F.md5("html").alias("html_md5"))


@query("s2_page_archive_write", """SELECT CASE page_id % 3 WHEN 0 THEN 'topcv' WHEN 1 THEN 'itviec' ELSE 'linkedin' END AS source,
  CAST(DATE '2024-01-01' + CAST(page_id % 10 AS INTEGER) AS DATE) AS crawl_date, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars
  FROM pages GROUP BY ALL""")
def s2(spark, sf):
    rows = archive.scan_pages(spark, archived(spark, sf))
    return rows.groupBy("source", "crawl_date").agg(
        F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars")
    )


@query("s3_batch_json_round_trip", JOBS + """SELECT title, company, logo_url, url, tags AS job_category, location AS working_location,
  salary, description AS descriptions, requirements, experience AS experiences, requirements AS level_of_education,
  work_arrangement AS work_model, posted AS posted_to_discord, crawled_at AS created_at FROM jobs_raw
  WHERE source = 'topcv' AND url IS NOT NULL""")
def s3(spark, sf):
    batch = state.dedup(staging_topcv(jobs_raw(spark, sf)), "url", ["id"]).drop("id")
    path = scratch_dir(spark, "crawl-batch")
    batches.write_batch(batch, path)
    return batches.read_batch(spark, path, STAGING_TOPCV)


@query("s5_two_catalog_read", JOBS + """SELECT source, count(*) AS jobs FROM jobs_raw WHERE source IN ('topcv', 'itviec')
  GROUP BY source""")
def s5(spark, sf):
    jobs = jobs_raw(spark, sf)
    catalogs = {"operational": scratch_dir(spark, "operational"), "lake": scratch_dir(spark, "lake")}
    staging_topcv(jobs).write.parquet(f"{catalogs['operational']}/staging/topcv_jobs")
    wh.bronze_itviec(staging_itviec(jobs)).write.parquet(f"{catalogs['lake']}/bronze/itviec_jobs")
    parts = {
        "topcv": tables.scan(spark, catalogs, "operational.staging.topcv_jobs"),
        "itviec": tables.scan(spark, catalogs, "lake.bronze.itviec_jobs"),
    }
    counted = [
        rows.agg(F.count("*").alias("jobs")).select(F.lit(name).alias("source"), "jobs")
        for name, rows in parts.items()
    ]
    return counted[0].unionByName(counted[1])


@query("s6_seed_tables", with_(*sql.SEEDS_SQL, sql.JOBS_SQL) + """SELECT region, city_en, count(*) AS jobs
  FROM jobs_raw JOIN city_map ON regexp_matches(lower(location), pattern) GROUP BY region, city_en""")
def s6(spark, sf):
    """Seed table joined to the postings' places, each distinct place matched once."""
    from ..operators.matching import join_patterns

    places = jobs_raw(spark, sf).select(F.lower("location").alias("place"))
    joined = join_patterns(places, "place", seeds.load_seed(spark, "vn_city_mapping"), "pattern")
    known = joined.filter(F.col("city_en").isNotNull())
    return known.groupBy("region", "city_en").agg(F.count("*").alias("jobs"))


OTHER_SEEDS = {
    "job_category_mapping": [("(?i)engineer|kỹ sư", "Engineer's work"), ("(?i)analyst", "Analysis, all of it")],
    "vn_city_mapping": [("hà nội|ha noi", "hn", "Capital", "North"), ("o'brien|cần thơ", "ct", "Delta's City", "South")],
}


@query("s6_replaced_seeds", with_(
    f"category_map(pattern, target) AS (VALUES {sql._values(OTHER_SEEDS['job_category_mapping'])})",
    f"city_map(pattern, city_code, city_en, region) AS (VALUES {sql._values(OTHER_SEEDS['vn_city_mapping'])})",
    sql.JOBS_SQL, *sql.BRONZE_SQL, *[c for c in sql.FACT_CTES if c not in (*sql.SEEDS_SQL, sql.JOBS_SQL, *sql.BRONZE_SQL)],
) + "SELECT job_category, job_location, count(*) AS jobs FROM fact GROUP BY ALL")
def s6_replaced(spark, sf):
    """The fact table built with seed files that replace the shipped ones."""
    loaded = {}
    for name, rows in OTHER_SEEDS.items():
        path = scratch_dir(spark, name)
        spark.createDataFrame(rows, seeds.SCHEMAS[name]).coalesce(1).write.csv(path, header=True)
        loaded[name] = seeds.seed_patterns(seeds.load_seed(spark, name, path))
    jobs, categories = jobs_raw(spark, sf), loaded["job_category_mapping"]
    topcv = wh.topcv_base(wh.bronze_topcv(staging_topcv(jobs)), categories)
    itviec = wh.itviec_base(wh.bronze_itviec(staging_itviec(jobs)), categories)
    built = wh.fact_jobs(topcv, itviec, cities=loaded["vn_city_mapping"])
    return built.groupBy("job_category", "job_location").agg(F.count("*").alias("jobs"))


@query("s7_materialisation", CLEAN + """SELECT location_clean, count(*) AS jobs FROM clean GROUP BY location_clean""")
def s7(spark, sf):
    staged = tables.materialize(tables.scan_jobs(jobs_raw(spark, sf)), "stg_jobs", "view")
    clean = tables.materialize(
        active.dim_jobs_clean(staged), "dim_jobs_clean", path=scratch_dir(spark, "dim-jobs-clean")
    )
    return clean.groupBy("location_clean").agg(F.count("*").alias("jobs"))


@query("s7_incremental", JOBS + """SELECT id, CASE WHEN order_key % 5 = 0 THEN upper(title) ELSE title END AS title, crawled_at
  FROM jobs_raw WHERE order_key % 3 = 0 OR order_key % 5 = 0""")
def s7_incremental(spark, sf):
    """A table built from one part of the postings, then brought up to date by an overlapping one."""
    path = scratch_dir(spark, "incremental-jobs")
    jobs = jobs_raw(spark, sf)
    first = jobs.filter("order_key % 3 = 0").select("id", "title", "crawled_at")
    second = jobs.filter("order_key % 5 = 0").select("id", F.upper("title").alias("title"), "crawled_at")
    tables.materialize(first, "jobs", "incremental", path, key=["id"])
    return tables.materialize(second, "jobs", "incremental", path, key=["id"])


@query("s8_flat_export", JOBS + "SELECT id, title, company, salary FROM jobs_raw WHERE coalesce(title, '') <> '' AND coalesce(company, '') <> '' AND coalesce(salary, '') <> ''")
def s8(spark, sf):
    rows = pages.require(jobs_raw(spark, sf), ["title", "company", "salary"])
    path = scratch_dir(spark, "flat-export")
    batches.export_csv(rows, ["id", "title", "company", "salary"], path)
    return spark.read.schema("id string, title string, company string, salary string").csv(
        path, header=True, escape='"'
    )
