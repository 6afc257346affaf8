"""Queries that check single Column expressions on the postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, experience, labels, location, posting, salary, text
from . import sql
from .fixtures import AS_OF, documents, jobs_raw, table
from .fixtures import pages as given_pages
from .registry import query
from .sql import CITY_BUCKET, EXPERIENCE_LEVEL, JOBS, SALARY_TYPE, case, q, re_, with_


def c(name: str) -> F.Column:
    return F.col(name)


@query("f1_case_and_trim", JOBS + """SELECT id, lower(trim(title)) AS low, upper(trim(title)) AS up FROM jobs_raw""")
def f1(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", text.lower_trim(c("title")).alias("low"), text.upper_trim(c("title")).alias("up")
    )


@query("f2_title_case", JOBS + f"SELECT DISTINCT title, {sql.title('title')} AS shown FROM jobs_raw")
def f2(spark, sf):
    return jobs_raw(spark, sf).select("title", text.title_case(c("title")).alias("shown")).distinct()


@query("f3_literal_replace", JOBS + """SELECT id, trim(replace(replace(lower(location), '(mới)', ''), '&', '-')) AS place,
  replace(salary, ',', '') AS pay FROM jobs_raw""")
def f3(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", location.normal_location(c("location")).alias("place"),
        F.replace("salary", F.lit(","), F.lit("")).alias("pay"),
    )


@query("f7_url_cleaning", JOBS + """SELECT id, string_split(url, '?ta_source')[1] AS cut,
  regexp_replace(regexp_extract(rtrim(string_split(url, '?')[1], '/'), '[^/]*$'), '\\.html$', '') AS segment FROM jobs_raw""")
def f7(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", text.cut_at(c("url"), "?ta_source").alias("cut"),
        text.last_segment(text.cut_at(c("url"), "?")).alias("segment"),
    )


@query("f8_city_bucket", JOBS + f"SELECT id, location, {CITY_BUCKET} AS city FROM jobs_raw")
def f8(spark, sf):
    return jobs_raw(spark, sf).select("id", "location", location.city_bucket(c("location")).alias("city"))


NUMBER = """CASE WHEN regexp_matches(t, '^\\d+[.,]\\d{0,2}$') THEN TRY_CAST(regexp_replace(t, '[.,]', '.') AS DOUBLE)
  ELSE TRY_CAST(regexp_replace(t, '[.,]', '', 'g') AS DOUBLE) END"""


@query("f10_localized_number", JOBS + f"""SELECT DISTINCT t AS token, CASE WHEN {NUMBER} > 0 THEN {NUMBER} END AS number
  FROM (SELECT unnest(regexp_extract_all(salary || ' 1,5 0 7.25', '\\d[\\d.,]*')) AS t FROM jobs_raw)""")
def f10(spark, sf):
    tokens = F.regexp_extract_all(F.concat("salary", F.lit(" 1,5 0 7.25")), F.lit(r"(\d[\d.,]*)"), F.lit(1))
    rows = jobs_raw(spark, sf).select(F.explode(tokens).alias("token")).distinct()
    return rows.select("token", salary.localized_number(c("token")).alias("number"))


BOUNDS = f"bounded AS (SELECT id, salary, {sql.min_salary('salary')} AS salary_min_million, {sql.max_salary('salary')} AS salary_max_million FROM jobs_raw)"


@query("f12_salary_bounds", with_(sql.JOBS_SQL, BOUNDS) + f"SELECT *, {sql.MID_SALARY} AS mid FROM bounded")
def f12(spark, sf):
    rows = jobs_raw(spark, sf).select(
        "id", "salary", salary.min_salary(c("salary")).alias("salary_min_million"),
        salary.max_salary(c("salary")).alias("salary_max_million"),
    )
    return rows.withColumn("mid", salary.mid_salary(c("salary_min_million"), c("salary_max_million")))


@query("f13_salary_type", JOBS + f"SELECT id, salary, {SALARY_TYPE} AS kind FROM jobs_raw")
def f13(spark, sf):
    return jobs_raw(spark, sf).select("id", "salary", salary.salary_type(c("salary")).alias("kind"))


@query("f14_digit_extraction", JOBS + f"SELECT id, salary, CAST({sql.ALL_DIGITS} AS BIGINT) AS digits FROM jobs_raw")
def f14(spark, sf):
    return jobs_raw(spark, sf).select("id", "salary", salary.all_digits(c("salary")).cast("bigint").alias("digits"))


RANGE = case(
    ("salary_min_million IS NULL AND salary_max_million IS NULL", q("Not Specified")),
    ("salary_min_million IS NULL", """CAST(CASE WHEN salary_max_million < 10000000 THEN 0
      ELSE (salary_max_million - 10000000) // 1000000 END AS VARCHAR) || '-' || CAST(salary_max_million AS VARCHAR) || 'M VND'"""),
    ("salary_max_million IS NULL", """CAST(salary_min_million // 1000000 AS VARCHAR) || '-'
      || CAST((salary_min_million + 10000000) // 1000000 AS VARCHAR) || 'M VND'"""),
    otherwise="CAST(salary_min_million // 1000000 AS VARCHAR) || '-' || CAST(salary_max_million // 1000000 AS VARCHAR) || 'M VND'",
)


@query("f15_salary_bands", with_(sql.JOBS_SQL, BOUNDS) + f"""SELECT id, {sql.band(sql.MID_SALARY)} AS band, {RANGE} AS shown
  FROM bounded""")
def f15(spark, sf):
    low, high = salary.min_salary(c("salary")), salary.max_salary(c("salary"))
    rows = jobs_raw(spark, sf).select("id", low.alias("low"), high.alias("high"))
    return rows.select(
        "id", salary.salary_band(salary.mid_salary(c("low"), c("high"))).alias("band"),
        salary.salary_range_text(c("low"), c("high")).alias("shown"),
    )


@query("f16_education_level", JOBS + f"SELECT id, requirements, {sql.education('requirements')} AS level FROM jobs_raw")
def f16(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", "requirements", experience.education_level(c("requirements")).alias("level")
    )


LOW_EXP = "lower(trim(experience))"


@query("f17_experience_months", JOBS + f"""SELECT id, experience, CASE
  WHEN {re_(LOW_EXP, r'không|chưa|fresher|intern|thực tập|no exp|0[\s]*năm')} THEN 0
  ELSE coalesce(TRY_CAST(regexp_extract({LOW_EXP}, '(\\d+)\\s*\\+?\\s*(năm|nam|year|yr)', 1) AS BIGINT) * 12,
    TRY_CAST(regexp_extract({LOW_EXP}, '(\\d+)\\s*(tháng|thang|month|mo)\\b', 1) AS BIGINT)) END AS months FROM jobs_raw""")
def f17(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", "experience", experience.experience_months(c("experience")).alias("months")
    )


@query("f18_experience_level", JOBS + f"SELECT id, experience, {EXPERIENCE_LEVEL} AS level FROM jobs_raw")
def f18(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", "experience", experience.experience_level(c("experience")).alias("level")
    )


PHRASED = f"phrased AS (SELECT id, {sql.phrase('coalesce(experience, requirements)')} AS phrase FROM jobs_raw)"
YEARS = f"counted AS (SELECT *, {sql.years('phrase')} AS years FROM phrased)"


def phrased(spark, sf):
    phrase = experience.experience_phrase(F.coalesce("experience", "requirements"))
    return jobs_raw(spark, sf).select("id", phrase.alias("phrase"))


@query("f19_experience_phrase", with_(sql.JOBS_SQL, PHRASED) + "SELECT * FROM phrased")
def f19(spark, sf):
    return phrased(spark, sf)


@query("f20_experience_number", with_(sql.JOBS_SQL, PHRASED, YEARS) + "SELECT * FROM counted")
def f20(spark, sf):
    return phrased(spark, sf).withColumn("years", experience.experience_years(c("phrase")))


@query("f21_experience_bands", with_(sql.JOBS_SQL, PHRASED, YEARS) + f"""SELECT id, {sql.year_steps('years', sql.YEAR_BANDS)} AS band,
  {sql.year_steps('years', sql.YEAR_RANKS)} AS level FROM counted""")
def f21(spark, sf):
    rows = phrased(spark, sf).withColumn("years", experience.experience_years(c("phrase")))
    return rows.select(
        "id", experience.experience_band(c("years")).alias("band"),
        experience.experience_rank(c("years")).alias("level"),
    )


@query("f22_work_model_forms", JOBS + f"""SELECT id, {sql.work_model('work_model')} AS model,
  {sql.arrangement('work_arrangement')} AS arrangement FROM jobs_raw""")
def f22(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", location.work_model(c("work_model")).alias("model"),
        location.work_arrangement(c("work_arrangement")).alias("arrangement"),
    )


@query("f23_calendar_parts", JOBS + """SELECT id, CAST(month(crawled_at) AS INTEGER) AS month,
  CAST(quarter(crawled_at) AS INTEGER) AS quarter, CAST(year(crawled_at) AS INTEGER) AS year,
  CAST(day(crawled_at) AS INTEGER) AS day_of_month, CAST(week(crawled_at) AS INTEGER) AS week_of_year,
  CAST(month(crawled_at) AS INTEGER) AS month_of_year FROM jobs_raw""")
def f23(spark, sf):
    rows = jobs_raw(spark, sf)
    return rows.select("id", *[v.alias(k) for k, v in dates.calendar_parts(c("crawled_at")).items()])


@query("f24_dates", JOBS + f"""SELECT id, CAST(crawled_at AS DATE) AS day,
  CAST(date_diff('day', CAST(crawled_at AS DATE), DATE '{AS_OF[:10]}') + 1 AS INTEGER) AS days,
  strftime(crawled_at, '%d/%m') AS label FROM jobs_raw""")
def f24(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", F.to_date("crawled_at").alias("day"),
        dates.days_active(F.to_date("crawled_at"), F.lit(AS_OF[:10]).cast("date")).alias("days"),
        F.date_format("crawled_at", "dd/MM").alias("label"),
    )


def _age(ts: str, now: str) -> str:
    minutes = f"date_sub('minute', {ts}, {now})"
    return case(
        (f"{ts} IS NULL", "''"), (f"{minutes} < 1", q("Vừa đăng")),
        (f"{minutes} < 60", f"{minutes} || ' phút trước'"),
        (f"{minutes} < 1440", f"({minutes} // 60) || ' giờ trước'"),
        (f"{minutes} < 2880", q("Hôm qua")),
        (f"{minutes} < 43200", f"({minutes} // 1440) || ' ngày trước'"),
        (f"{minutes} < 86400", q("1 tháng trước")),
        otherwise=f"({minutes} // 43200) || ' tháng trước'",
    )


AGED = """aged AS (SELECT event_id, ts AS crawled, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('day', ts)
  ELSE ts - INTERVAL 5 HOUR END AS posted, TIMESTAMP '2024-02-01 00:00:00' AS now FROM events)"""
DATE_ONLY = "posted = date_trunc('day', posted) AND CAST(posted AS DATE) = CAST(crawled AS DATE)"


@query("f25_display_maps", with_(sql.AUDIT_SQL, AGED) + f"""SELECT event_id,
  {_age(f"CASE WHEN posted IS NULL OR ({DATE_ONLY}) THEN crawled ELSE posted END", 'now')} AS age FROM aged""")
def f25(spark, sf):
    ts, now = c("ts"), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    posted = F.when(c("event_id") % 3 == 1, F.date_trunc("DAY", ts)).when(
        c("event_id") % 3 == 2, ts - F.expr("INTERVAL 5 HOURS")
    )
    rows = table(spark, sf, "events").select("event_id", "ts", posted.alias("posted"))
    return rows.select("event_id", dates.job_age(c("posted"), ts, now).alias("age"))


@query("f25_source_names", JOBS + """SELECT id, CASE source WHEN 'topcv' THEN 'TopCV' WHEN 'linkedin' THEN 'LinkedIn'
  WHEN 'itviec' THEN 'ITViec' WHEN 'vieclam24h' THEN 'Việc Làm 24h' ELSE source END AS shown FROM jobs_raw""")
def f25_sources(spark, sf):
    return jobs_raw(spark, sf).select("id", labels.source_name(c("source")).alias("shown"))


EMPLOYMENT = case(
    (re_("lower(coalesce(title, ''))", "intern|thực tập|thuc tap"), q("INTERN")),
    (re_("lower(coalesce(title, ''))", r"part[\s-]?time|bán thời gian|ban thoi gian"), q("PART_TIME")),
    (re_("lower(coalesce(title, ''))", r"\bcontract\b|freelance|cộng tác viên|\bctv\b"), q("CONTRACTOR")),
    otherwise=q("FULL_TIME"),
)


@query("f29_employment_type", JOBS + f"SELECT id, title, {EMPLOYMENT} AS kind FROM jobs_raw")
def f29(spark, sf):
    return jobs_raw(spark, sf).select("id", "title", posting.employment_type(c("title")).alias("kind"))


MONTHS = f"""CASE WHEN {re_(LOW_EXP, r'không|chưa|fresher|intern|thực tập|no exp|0[\s]*năm')} THEN 0
  ELSE TRY_CAST(regexp_extract({LOW_EXP}, '(\\d+)\\s*\\+?\\s*(năm|nam|year|yr)', 1) AS BIGINT) * 12 END"""


@query("f30_posting_document", with_(sql.JOBS_SQL, *sql.pay_ctes("jobs_raw")) + f"""SELECT id,
  strftime(crawled_at + INTERVAL 14 DAY, '%Y-%m-%dT%H:%M:%S.000Z') AS valid_through, {EMPLOYMENT} AS employment_type,
  nullif(location, '') AS region, nullif(company, '') AS company, {MONTHS} AS months, pay_currency AS currency,
  CAST(pay_min AS BIGINT) AS min_value, CAST(pay_max AS BIGINT) AS max_value,
  coalesce(contains(description, '<'), false) AS escaped FROM paid""")
def f30(spark, sf):
    """Fields read back from the document, and whether markup was escaped."""
    rows = jobs_raw(spark, sf).select("id", "description", posting.posting_document(
        c("title"), c("company"), c("description"), c("location"), c("salary"), c("experience"),
        c("crawled_at"), c("url"),
    ).alias("doc"))

    schema = (
        "validThrough string, employmentType string, jobLocation struct<address:struct<addressRegion:string>>, "
        "hiringOrganization struct<name:string>, experienceRequirements struct<monthsOfExperience:bigint>, "
        "baseSalary struct<currency:string,value:struct<minValue:bigint,maxValue:bigint>>"
    )
    read = rows.select("id", "doc", F.from_json("doc", schema).alias("read"))

    def field(path: str) -> F.Column:
        return F.col(f"read.{path}")

    return read.select(
        "id", field("validThrough").alias("valid_through"),
        field("employmentType").alias("employment_type"),
        field("jobLocation.address.addressRegion").alias("region"),
        field("hiringOrganization.name").alias("company"),
        field("experienceRequirements.monthsOfExperience").alias("months"),
        field("baseSalary.currency").alias("currency"),
        field("baseSalary.value.minValue").alias("min_value"),
        field("baseSalary.value.maxValue").alias("max_value"),
        (c("doc").contains("\\u003c") & ~c("doc").contains("<")).alias("escaped"),
    )


@query("f31_embedding_text", JOBS + """SELECT id, 'Title: ' || coalesce(title, '') || '. Experience: ' || coalesce(experience, '')
  || '. Description: ' || coalesce(description, '') || '. Requirements: ' || coalesce(requirements, '') AS long_text,
  regexp_replace('Title: ' || coalesce(title, 'null') || chr(10) || 'Requirements: ' || coalesce(requirements, 'null')
  || chr(10) || 'Description: ' || coalesce(description, 'null'), '<[^>]*>?', '', 'g') AS short_text FROM jobs_raw""")
def f31(spark, sf):
    return jobs_raw(spark, sf).select(
        "id",
        posting.embedding_text(c("title"), c("experience"), c("description"), c("requirements")).alias("long_text"),
        posting.embedding_text_short(c("title"), c("requirements"), c("description")).alias("short_text"),
    )


FACTS = """concat_ws(' · ', 'Mức lương: ' || nullif(salary, ''), nullif(location, ''), nullif(experience, ''))"""
STRIPPED = "trim(regexp_replace(replace(regexp_replace(description, '<[^>]*>?', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"


@query("f35_text_caps", JOBS + f"""SELECT id, CASE WHEN length(coalesce(nullif(description, ''), 'N/A')) <= 20
  THEN coalesce(nullif(description, ''), 'N/A') ELSE substring(description, 1, 19) || '…' END AS capped,
  coalesce(nullif(CASE WHEN coalesce(description, '') <> '' THEN substring({STRIPPED}, 1, 160)
    ELSE substring({FACTS}, 1, 200) END, ''),
    'Việc làm ' || title || ' tại ' || coalesce(company, 'công ty') || ' — Jobs') AS snippet FROM jobs_raw""")
def f35(spark, sf):
    return jobs_raw(spark, sf).select(
        "id", text.ellipsis(c("description"), 20).alias("capped"),
        labels.snippet(
            c("title"), c("company"), c("description"), c("salary"), c("location"), c("experience"), "Jobs"
        ).alias("snippet"),
    )


@query("f36_http_url", """SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN
  CASE WHEN regexp_matches(url, '^https?://[^/?#]+$') THEN url || '/' ELSE url END END AS safe FROM pages""")
def f36(spark, sf):
    return given_pages(spark, sf).select("page_id", text.http_url(c("url")).alias("safe"))


SHOWN = r"regexp_replace({}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"
TEXT_ONLY = "trim(regexp_replace(replace(regexp_replace(" + SHOWN + ", '<[^>]*>?', '', 'g'), '&nbsp;', ' '), '\\s+', ' ', 'g'))"


@query("h14_strip_markup", f"""SELECT 'page' AS kind, page_id AS id, md5({TEXT_ONLY.format('html')}) AS text_md5 FROM pages
  UNION ALL SELECT 'document', doc_id, md5({TEXT_ONLY.format('text')}) FROM documents""")
def h14(spark, sf):
    from_pages = given_pages(spark, sf).select(
        F.lit("page").alias("kind"), c("page_id").alias("id"), F.md5(text.strip_tags(c("html"))).alias("text_md5")
    )
    from_documents = documents(spark, sf).select(
        F.lit("document").alias("kind"), c("doc_id").alias("id"), F.md5(text.strip_tags(c("text"))).alias("text_md5")
    )
    return from_pages.unionByName(from_documents)


@query("h6_node_text", """SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text_md5 FROM documents""")
def h6(spark, sf):
    return documents(spark, sf).select("doc_id", F.md5(text.squeeze(c("text"))).alias("text_md5"))
