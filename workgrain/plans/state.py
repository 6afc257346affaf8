"""Queries of alerts, state tables, quality checks and the run ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alerts as rules
from ..operators import audit, digest, quality, state
from ..operators import warehouse as wh
from ..schemas import LEDGER_KEY, POSTING_TEXT
from . import sql
from .fixtures import AS_OF, alerts, as_of, jobs_audit, jobs_raw, staging_itviec, staging_topcv, table
from .registry import query
from .serving import jobs_with_vectors
from .sql import ALERTS, AUDIT, JOBS, case, q, with_

# ---- alerts ----


def _member(key: str) -> str:
    return f"json_extract_string(filters, '$.{key}')"


def _kept(key: str) -> str:
    return f"CASE WHEN {_member(key)} <> 'all' THEN nullif(trim({_member(key)}), '') END"


CLEAN_ITEMS = ", ".join(f"{_kept(k)} AS w_{k}" for k in rules.KEY_CAPS)
UNSUPPORTED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN trim({_member(k)}) <> '' AND {_member(k)} <> 'all' THEN '{k}' END"
    for k in rules.UNSUPPORTED_KEYS
) + ")"
DESCRIBED = """coalesce(nullif(concat_ws(' · ', w_category, CASE WHEN w_role IS DISTINCT FROM w_category THEN w_role END,
  w_level, w_experience, w_location, w_salary, '"' || w_keyword || '"'), ''), 'Tất cả việc làm')"""


@query("f32_alert_filters", with_(sql.ALERTS_SQL, f"cleaned AS (SELECT *, {CLEAN_ITEMS} FROM alerts)") + f"""SELECT
  alert_id, w_category AS category, w_keyword AS keyword, w_location AS location, w_salary AS salary,
  {UNSUPPORTED} AS unsupported, {DESCRIBED} AS described FROM cleaned""")
def f32(spark, sf):
    rows = alerts(spark, sf).withColumn("wanted", rules.clean_filters(F.col("filters")))
    return rows.select(
        "alert_id",
        *[F.col(f"wanted.{k}").alias(k) for k in ("category", "keyword", "location", "salary")],
        rules.unsupported_filters(F.col("filters")).alias("unsupported"),
        rules.describe_filters(F.col("wanted")).alias("described"),
    )


NOW = f"TIMESTAMP '{AS_OF}'"
HOUR = f"hour(({NOW} AT TIME ZONE 'UTC') AT TIME ZONE timezone)"
DUE_SQL = f"""due AS (SELECT *, {CLEAN_ITEMS}, coalesce(last_delivered_job_at, {NOW} - INTERVAL 48 HOUR) AS cutoff
  FROM alerts WHERE active AND {HOUR} = 8
  AND (last_sent_at IS NULL OR last_sent_at <= {NOW} - INTERVAL 23 HOUR))"""
READY_SQL = f"""ready AS (SELECT * FROM due WHERE NOT is_blocked AND coalesce(email, '') <> ''
  AND (last_sent_at IS NOT NULL OR created_at <= {NOW} - INTERVAL 1 HOUR) AND {UNSUPPORTED} = '')"""


@query("f33_local_hour_due", ALERTS + f"""SELECT alert_id, timezone, CAST({HOUR} AS INTEGER) AS local_hour,
  {HOUR} = 8 AND (last_sent_at IS NULL OR last_sent_at <= {NOW} - INTERVAL 23 HOUR) AS is_due,
  last_sent_at IS NOT NULL OR created_at <= {NOW} - INTERVAL 1 HOUR AS past_cooldown FROM alerts""")
def f33(spark, sf):
    zone, sent, now = F.col("timezone"), F.col("last_sent_at"), as_of()
    return alerts(spark, sf).select(
        "alert_id", "timezone",
        rules.local_hour(now, zone).alias("local_hour"),
        rules.is_due(zone, sent, now).alias("is_due"),
        rules.past_cooldown(sent, F.col("created_at"), now).alias("past_cooldown"),
    )


def owned(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Alerts without contact fields, and one owner per alert who has them."""
    rows = alerts(spark, sf).withColumn("user_id", F.col("alert_id"))
    return rows.drop("email", "is_blocked"), rows.select("user_id", "email", "is_blocked")


@query("j10_alert_user_join", ALERTS + """SELECT alert_id, email FROM alerts
  WHERE NOT is_blocked AND coalesce(email, '') <> ''""")
def j10(spark, sf):
    return digest.reachable(digest.attach_users(*owned(spark, sf))).select("alert_id", "email")


@query("j10_many_alerts_per_user", with_(sql.ALERTS_SQL, """users AS (SELECT user_id, min(email) AS email,
  count(*) FILTER (is_blocked) > 2 AS is_blocked FROM alerts GROUP BY user_id)""") + """SELECT a.alert_id, a.user_id, u.email
  FROM alerts a JOIN users u ON a.user_id = u.user_id WHERE NOT u.is_blocked AND coalesce(u.email, '') <> ''""")
def j10_many(spark, sf):
    """Forty users own all alerts; a user with three blocked ones counts as blocked."""
    rows = alerts(spark, sf)
    users = rows.groupBy("user_id").agg(F.min("email").alias("email"), (F.count_if("is_blocked") > 2).alias("is_blocked"))
    attached = digest.attach_users(rows.drop("email", "is_blocked"), users)
    return digest.reachable(attached).select("alert_id", "user_id", "email")


JOB_PLACE = "trim(regexp_replace(regexp_replace(lower(location), '[._-]+', ' ', 'g'), '\\s+', ' ', 'g'))"
FLOOR = "coalesce(pay_min, pay_value, pay_max)"
HN, HCM, DN = (["hà nội", "ha noi"], ["hồ chí minh", "ho chi minh", "hcm"], ["đà nẵng", "da nang"])


def _holds(col: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(n)})" for n in names) + ")"


PLACE_TEST = case(
    ("w_location IS NULL", "true"),
    ("coalesce(location, '') = ''", "false"),
    ("w_location = 'other'", f"NOT {_holds('place', HN + HCM + DN)}"),
    *[(_holds("lower(w_location)", names), _holds("place", names)) for names in (HN, HCM, DN)],
    otherwise="contains(place, lower(w_location))",
)
VND_M = f"pay_currency = 'VND' AND {FLOOR} / 1000000"
PAY_TEST = case(
    ("w_salary IS NULL", "true"),
    ("w_salary = 'deal'", "salary IS NULL OR trim(salary) = '' OR regexp_matches(lower(salary), 'thỏa\\s*thuận|tho\\s*thu')"),
    ("w_salary = 'under10'", f"{VND_M} < 10"),
    ("w_salary = '10to20'", f"{VND_M} BETWEEN 10 AND 20"),
    ("w_salary = '20to30'", f"{VND_M} BETWEEN 20 AND 30"),
    ("w_salary = '30to50'", f"{VND_M} BETWEEN 30 AND 50"),
    ("w_salary = 'over50'", f"{VND_M} > 50"),
    ("w_salary = 'usd_under1k'", f"pay_currency = 'USD' AND {FLOOR} < 1000"),
    ("w_salary = 'usd_1kto2k'", f"pay_currency = 'USD' AND {FLOOR} BETWEEN 1000 AND 2000"),
    ("w_salary = 'usd_over2k'", f"pay_currency = 'USD' AND {FLOOR} > 2000"),
    otherwise="false",
)
WORD_TEST = """(w_keyword IS NULL
  OR contains(lower(coalesce(nullif(title, ''), 'Chưa có tiêu đề')), lower(w_keyword))
  OR contains(lower(coalesce(nullif(company, ''), 'Không rõ công ty')), lower(w_keyword)))"""


def match_ctes(start: str) -> tuple[str, ...]:
    """CTEs up to ``matched``: up to ten oldest matches per ready alert."""
    return (
        sql.JOBS_SQL, sql.ALERTS_SQL, DUE_SQL, READY_SQL,
        *sql.pay_ctes("jobs_raw"),
        f"scanned AS (SELECT *, {JOB_PLACE} AS place FROM paid WHERE crawled_at > {start})",
        f"""matched AS (SELECT alert_id, id, crawled_at, place_in FROM (SELECT a.alert_id, j.id, j.crawled_at,
  row_number() OVER (PARTITION BY a.alert_id ORDER BY j.crawled_at, j.id) AS place_in
  FROM ready a JOIN scanned j ON j.crawled_at > a.cutoff AND {WORD_TEST} AND ({PLACE_TEST}) AND ({PAY_TEST}))
  WHERE place_in <= 10)""",
        """per_alert AS (SELECT alert_id, string_agg(id, ',' ORDER BY crawled_at, id) AS job_ids,
  max(crawled_at) AS newest FROM matched GROUP BY alert_id)""",
    )


EARLIEST = f"(SELECT least(min(last_delivered_job_at), {NOW} - INTERVAL 48 HOUR) FROM due)"
DIGEST = match_ctes(EARLIEST)


@query("j9_alert_job_match", with_(*match_ctes("TIMESTAMP '1990-01-01'")) + """SELECT alert_id, id AS job_id,
  CAST(place_in AS INTEGER) AS place FROM matched""")
def j9(spark, sf):
    """Matches from the very first posting on, so that most filters find some."""
    from ..operators.search import labelled

    ready = digest.sendable(digest.due(alerts(spark, sf), as_of()), as_of())
    jobs = labelled(jobs_raw(spark, sf)).select(
        F.col("id").alias("job_id"), F.col("created_at").alias("job_at"),
        "title", "company", "location", "salary", "category", "experience", "level",
    )
    found = digest.match_alerts(ready, jobs)
    return found.select(
        "alert_id", F.posexplode(F.transform("found", lambda j: j["job_id"])).alias("place", "job_id")
    ).select("alert_id", "job_id", (F.col("place") + 1).cast("int").alias("place"))


def run(spark: SparkSession, sf: str) -> digest.Digest:
    attached = digest.attach_users(*owned(spark, sf))
    failed = attached.filter("alert_id = 'al-8'").select("alert_id")
    return digest.run_digest(attached, jobs_raw(spark, sf), as_of(), failed)


@query("u7_digest_outbox", with_(*DIGEST) + f"""SELECT r.alert_id, email, name, p.job_ids, {DESCRIBED} AS filters_text,
  CASE WHEN r.alert_id = 'al-8' THEN 'failed' ELSE 'sent' END AS status
  FROM ready r JOIN per_alert p ON p.alert_id = r.alert_id""")
def u7_outbox(spark, sf):
    return run(spark, sf).outbox.withColumn("job_ids", F.array_join("job_ids", ","))


NEWEST = "(SELECT max(crawled_at) FROM scanned)"
SENT = "p.job_ids IS NOT NULL AND r.alert_id <> 'al-8'"


@query("u7_digest_cursors", with_(*DIGEST) + f"""SELECT r.alert_id,
  CASE WHEN {SENT} THEN {NOW} ELSE last_sent_at END AS last_sent_at,
  CASE WHEN {SENT} THEN p.newest WHEN p.job_ids IS NULL AND {NEWEST} > cutoff THEN {NEWEST}
    ELSE last_delivered_job_at END AS last_delivered_job_at
  FROM ready r LEFT JOIN per_alert p ON p.alert_id = r.alert_id""")
def u7_cursors(spark, sf):
    return run(spark, sf).cursors


@query("u7_digest_deliveries", with_(*DIGEST) + f"""SELECT alert_id, {NOW} AS sent_at, job_ids FROM per_alert
  WHERE alert_id <> 'al-8'""")
def u7_deliveries(spark, sf):
    return run(spark, sf).deliveries.withColumn("job_ids", F.array_join("job_ids", ","))


@query("a24_digest_summary", with_(*DIGEST) + """SELECT (SELECT count(*) FROM due) AS alerts_processed,
  count(*) AS alerts_with_matches, count(*) FILTER (alert_id <> 'al-8') AS emails_sent,
  count(*) FILTER (alert_id = 'al-8') AS emails_failed, (SELECT count(*) FROM scanned) AS jobs_scanned
  FROM per_alert""")
def a24(spark, sf):
    return run(spark, sf).summary


WISHES = """wishes(w_keyword, w_location, w_salary, wish) AS (VALUES ('ENGINEER', NULL, NULL, 'word'),
  (NULL, 'TP.Hồ Chí Minh', NULL, 'hcm'), (NULL, 'other', NULL, 'other'), (NULL, 'cần_thơ', NULL, 'text'),
  """ + ", ".join(f"(NULL, NULL, '{c}', '{c}')" for c in rules.SALARY_CHOICES[1:]) + ")"
PREDICATE_SQL = with_(
    sql.JOBS_SQL, *sql.pay_ctes("jobs_raw"), WISHES,
    f"placed AS (SELECT *, {JOB_PLACE} AS place FROM paid)",
)
PLAIN_WANT = PLACE_TEST.replace(
    "lower(w_location)", "trim(regexp_replace(lower(w_location), '[._-]+', ' ', 'g'))"
)


def _wish_counts(spark: SparkSession, sf: str, names: list[str] | None = None) -> DataFrame:
    """Postings per sample filter, by the plain predicate."""
    samples = [
        ("word", {"keyword": "ENGINEER"}), ("hcm", {"location": "TP.Hồ Chí Minh"}),
        ("other", {"location": "other"}), ("text", {"location": "cần_thơ"}),
        *[(c, {"salary": c}) for c in rules.SALARY_CHOICES[1:]],
    ]

    def wanted(values: dict[str, str]) -> F.Column:
        return F.struct(*[F.lit(values.get(k)).cast("string").alias(k) for k in rules.KEY_CAPS])
    from ..operators.search import labelled

    jobs = labelled(jobs_raw(spark, sf))
    job = {c: F.col(c) for c in ("title", "company", "location", "salary", "category", "experience", "level")}
    tests = [
        F.count_if(rules.matches(job, wanted(values))).alias(f"t{i}")
        for i, (name, values) in enumerate(samples) if names is None or name in names
    ]
    items = ", ".join(
        f"'{name}', t{i}" for i, (name, _) in enumerate(samples) if names is None or name in names
    )
    return jobs.agg(*tests).selectExpr(f"stack({len(tests)}, {items}) AS (wish, jobs)")


def _predicate_twin(names: str = "true") -> str:
    return PREDICATE_SQL + f"""SELECT wish, count(*) FILTER ({WORD_TEST} AND ({PLAIN_WANT}) AND ({PAY_TEST})) AS jobs
  FROM wishes CROSS JOIN placed WHERE {names} GROUP BY wish"""


@query("p12_alert_predicate", _predicate_twin())
def p12(spark, sf):
    return _wish_counts(spark, sf)


@query("p13_alert_location", _predicate_twin("wish IN ('hcm', 'other', 'text')"))
def p13(spark, sf):
    return _wish_counts(spark, sf, ["hcm", "other", "text"])


@query("p14_alert_salary", _predicate_twin("w_salary IS NOT NULL"))
def p14(spark, sf):
    return _wish_counts(spark, sf, list(rules.SALARY_CHOICES[1:]))


# ---- state tables ----

TARGET = "target AS (SELECT j.*, embedding IS NOT NULL AS has_vector FROM jobs_raw j LEFT JOIN embeddings ON vec_id = order_key WHERE order_key % 7 <> 0)"
BATCH = """batch AS (SELECT * REPLACE (CASE WHEN order_key % 10 = 0 THEN title || ' II' ELSE title END AS title,
  crawled_at + INTERVAL 1 DAY AS crawled_at, 'new' AS salary) FROM jobs_raw WHERE order_key % 5 = 0)"""


def target_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    jobs = jobs_raw(spark, sf)
    columns = [*POSTING_TEXT, "crawled_at"]
    target = jobs_with_vectors(spark, sf).filter("order_key % 7 <> 0").select(*columns, "embedding")
    retitled = F.when(F.col("order_key") % 10 == 0, F.concat("title", F.lit(" II"))).otherwise(F.col("title"))
    batch = jobs.filter("order_key % 5 = 0").withColumns({
        "title": retitled,
        "crawled_at": F.col("crawled_at") + F.expr("INTERVAL 1 DAY"),
        "salary": F.lit("new"),
    }).select(*columns)
    return target, batch


@query("u1_canonical_upsert", with_(sql.JOBS_SQL, TARGET, BATCH) + """SELECT coalesce(b.id, t.id) AS id,
  CASE WHEN b.id IS NULL THEN t.title ELSE b.title END AS title,
  CASE WHEN b.id IS NULL THEN t.salary ELSE b.salary END AS salary, coalesce(t.crawled_at, b.crawled_at) AS crawled_at,
  coalesce(t.has_vector, false) AND (b.id IS NULL OR NOT (t.title IS DISTINCT FROM b.title
    OR t.experience IS DISTINCT FROM b.experience OR t.description IS DISTINCT FROM b.description
    OR t.requirements IS DISTINCT FROM b.requirements)) AS has_vector
  FROM target t FULL JOIN batch b ON t.id = b.id""")
def u1(spark, sf):
    rows = state.upsert_jobs(*target_and_batch(spark, sf))
    return rows.select("id", "title", "salary", "crawled_at", F.col("embedding").isNotNull().alias("has_vector"))


@query("u1_repeated_ids", with_(sql.JOBS_SQL, """batch AS (SELECT id, title, crawled_at, 0 AS seq FROM jobs_raw WHERE order_key % 5 < 3
  UNION ALL SELECT id, 'again ' || id, crawled_at + INTERVAL 1 DAY, 1 FROM jobs_raw WHERE order_key % 5 = 0
  UNION ALL SELECT id, 'third ' || id, crawled_at - INTERVAL 1 DAY, 2 FROM jobs_raw WHERE order_key % 10 = 0)""",
  "last AS (SELECT id, max_by(title, seq) AS title, min_by(crawled_at, seq) AS crawled_at FROM batch GROUP BY id)",
  "target AS (SELECT id, title, crawled_at FROM jobs_raw WHERE order_key % 7 <> 0)") + """SELECT id,
  CASE WHEN b.id IS NULL THEN t.title ELSE b.title END AS title, coalesce(t.crawled_at, b.crawled_at) AS crawled_at
  FROM target t FULL JOIN last b USING (id)""")
def u1_repeated(spark, sf):
    """A batch that names an id up to three times: the last text wins, the first crawl time stays."""
    jobs = jobs_raw(spark, sf)
    columns = [*POSTING_TEXT, "crawled_at"]
    target = jobs_with_vectors(spark, sf).filter("order_key % 7 <> 0").select(*columns, "embedding")

    def copy(rows: DataFrame, word: str, days: int, seq: int) -> DataFrame:
        return rows.withColumns({
            "title": F.concat(F.lit(f"{word} "), "id"), "crawled_at": F.col("crawled_at") + F.expr(f"INTERVAL {days} DAY"),
            "seq": F.lit(seq),
        }).select(*columns, "seq")

    first = jobs.filter("order_key % 5 < 3").select(*columns, F.lit(0).alias("seq"))
    batch = first.unionByName(copy(jobs.filter("order_key % 5 = 0"), "again", 1, 1))
    batch = batch.unionByName(copy(jobs.filter("order_key % 10 = 0"), "third", -1, 2))
    return state.upsert_jobs(target, batch, ["seq"]).select("id", "title", "crawled_at")


@query("u1_upsert_rerun", with_(sql.JOBS_SQL, TARGET, BATCH) + """SELECT (SELECT count(*) FROM target FULL JOIN batch USING (id)) AS jobs,
  (SELECT count(DISTINCT coalesce(t.id, b.id)) FROM target t FULL JOIN batch b ON t.id = b.id) AS ids,
  CAST(0 AS BIGINT) AS changed""")
def u1_rerun(spark, sf):
    """The same batch twice: no new ids and no changed rows."""
    target, batch = target_and_batch(spark, sf)
    once = state.upsert_jobs(target, batch)
    twice = state.upsert_jobs(once, batch)
    mark = F.md5(F.to_json(F.struct(*[F.col(c) for c in once.columns])))
    marks = once.select("id", mark.alias("first")).join(twice.select("id", mark.alias("second")), "id", "full")
    return marks.agg(
        F.count("*").alias("jobs"), F.count_distinct("id").alias("ids"),
        F.count_if(~F.col("first").eqNullSafe(F.col("second"))).alias("changed"),
    )


@query("u3_keyed_upsert", JOBS + """SELECT t.id, t.url, CASE WHEN b.url IS NULL THEN t.title ELSE upper(t.title) END AS title,
  t.posted AS posted_to_discord, t.crawled_at AS created_at FROM jobs_raw t
  LEFT JOIN jobs_raw b ON t.url = b.url AND b.order_key % 5 = 0 AND b.source = 'topcv'
  WHERE t.source = 'topcv' AND t.order_key % 7 <> 0
  UNION ALL SELECT id, url, upper(title), posted, crawled_at FROM jobs_raw WHERE source = 'topcv'
  AND order_key % 5 = 0 AND order_key % 7 = 0 AND url IS NOT NULL""")
def u3(spark, sf):
    jobs = jobs_raw(spark, sf)
    target = staging_topcv(jobs.filter("order_key % 7 <> 0"))
    fresh = staging_topcv(jobs.filter("order_key % 5 = 0"))
    batch = state.dedup(fresh.withColumn("title", F.upper("title")), "url", ["id"])
    columns = [c for c in target.columns if c not in ("id", "url", "posted_to_discord", "created_at")]
    merged = state.upsert(target, batch, "url", columns)
    return merged.select("id", "url", "title", "posted_to_discord", "created_at")


@query("u4_insert_if_absent", JOBS + """SELECT id, title FROM jobs_raw WHERE order_key % 5 = 0 AND order_key % 7 = 0""")
def u4(spark, sf):
    jobs = jobs_raw(spark, sf)
    _, inserted = state.insert_new(jobs.filter("order_key % 7 <> 0"), jobs.filter("order_key % 5 = 0"), "id")
    return inserted.select("id", "title")


@query("u5_batch_dedup", JOBS + """SELECT company, id FROM (SELECT company, id, row_number() OVER (PARTITION BY company
  ORDER BY crawled_at, id) AS place FROM jobs_raw WHERE coalesce(company, '') <> '') WHERE place = 1""")
def u5(spark, sf):
    return state.dedup(jobs_raw(spark, sf), "company", ["crawled_at", "id"]).select("company", "id")


@query("w4_dedup_cleaned_url", JOBS + """SELECT url, min(id) AS id FROM (SELECT
  trim(string_split('https://jobs.example/viec-lam/' || CAST(order_key // 3 AS VARCHAR) || '.html?ta_source=' || id,
  '?ta_source')[1]) AS url, id FROM jobs_raw) GROUP BY url""")
def w4(spark, sf):
    tracked = F.concat(
        F.lit("https://jobs.example/viec-lam/"), F.floor(F.col("order_key") / 3).cast("string"),
        F.lit(".html?ta_source="), F.col("id"),
    )
    rows = jobs_raw(spark, sf).withColumn("url", tracked)
    return state.dedup_cleaned_urls(rows).select("url", "id")


BRONZE = with_(sql.JOBS_SQL, *sql.BRONZE_SQL)
MARK = "TIMESTAMP '2001-06-01'"


@query("u2_bronze_incremental", BRONZE + f"""SELECT id, url, title, salary, created_at FROM bronze_topcv
  WHERE created_at <= {MARK} OR url IS NOT NULL""")
def u2(spark, sf):
    source = staging_topcv(jobs_raw(spark, sf))
    target = wh.bronze_topcv(source.filter(F.col("created_at") <= F.lit("2001-06-01").cast("timestamp_ntz")))
    rows = state.bronze_incremental(source, target, wh.bronze_topcv)
    return rows.select("id", "url", "title", "salary", "created_at")


KNOWN = "jobs_raw WHERE source = 'topcv' AND order_key % 2 = 0"


@query("j5_new_logos", JOBS + f"""SELECT DISTINCT logo_url FROM jobs_raw WHERE source IN ('topcv', 'itviec')
  AND logo_url IS NOT NULL AND logo_url NOT IN (SELECT logo_url FROM {KNOWN} AND logo_url IS NOT NULL)""")
def j5(spark, sf):
    jobs = jobs_raw(spark, sf)
    known = state.distinct_logos(staging_topcv(jobs.filter("order_key % 2 = 0")))
    return state.new_logos(known, staging_itviec(jobs), staging_topcv(jobs))


@query("x2_union_distinct", JOBS + """SELECT logo_url FROM jobs_raw WHERE source = 'itviec' AND logo_url IS NOT NULL
  UNION SELECT logo_url FROM jobs_raw WHERE source = 'topcv' AND logo_url IS NOT NULL""")
def x2(spark, sf):
    jobs = jobs_raw(spark, sf)
    return state.distinct_logos(staging_itviec(jobs), staging_topcv(jobs))


@query("f6_logo_ids", JOBS + """SELECT DISTINCT logo_url, md5(logo_url) AS logo_id FROM jobs_raw
  WHERE source IN ('topcv', 'itviec') AND logo_url IS NOT NULL""")
def f6(spark, sf):
    jobs = jobs_raw(spark, sf)
    empty = state.distinct_logos(staging_topcv(jobs)).limit(0).withColumn("logo_id", F.lit(None).cast("string"))
    return state.register_logos(empty, staging_itviec(jobs), staging_topcv(jobs))


LAST = "regexp_replace(regexp_extract(rtrim(url, '/'), '[^/]*$'), '\\.html$', '')"


@query("j6_crawl_candidates", JOBS + f"""SELECT id, url FROM (SELECT DISTINCT url, {LAST} AS id FROM (
  SELECT string_split(url, '?')[1] AS url FROM jobs_raw WHERE url IS NOT NULL))
  WHERE id NOT IN (SELECT CAST(order_key AS VARCHAR) FROM jobs_raw WHERE order_key % 3 = 0) ORDER BY url LIMIT 40""")
def j6(spark, sf):
    jobs = jobs_raw(spark, sf)
    urls = jobs.filter("url IS NOT NULL").select(F.substring_index("url", "?", 1).alias("url"))
    known = jobs.filter("order_key % 3 = 0").select(F.col("order_key").cast("string").alias("id"))
    return state.candidates(urls, known).select("id", "url")


@query("j11_mark_posted", JOBS + """SELECT id, url, posted OR (url IS NOT NULL AND order_key % 4 = 0) AS posted_to_discord
  FROM jobs_raw WHERE source = 'topcv'""")
def j11(spark, sf):
    jobs = jobs_raw(spark, sf)
    sent = jobs.filter("order_key % 4 = 0").select("url")
    return state.mark_posted(staging_topcv(jobs), sent).select("id", "url", "posted_to_discord")


@query("u6_delivery_flag", JOBS + """SELECT posted OR (url IS NOT NULL AND order_key % 4 = 0) AS posted_to_discord,
  count(*) AS jobs FROM jobs_raw WHERE source = 'topcv' GROUP BY 1""")
def u6(spark, sf):
    """The flag written back into the keyed table of its source, a commit for each half of the sent urls, and read again."""
    from ..session import scratch_dir
    from ..sources.keyed import KeyedTable

    jobs = jobs_raw(spark, sf)
    stored = KeyedTable(spark, scratch_dir(spark, "delivery-flags"), ["url"], buckets=16)
    stored.apply(staging_topcv(jobs), lambda held, batch: batch)
    for half in (0, 4):
        stored.apply(jobs.filter(f"order_key % 8 = {half}").select("url"), state.mark_posted)
    return stored.read().groupBy("posted_to_discord").agg(F.count("*").alias("jobs"))


@query("p11_unposted_rows", JOBS + """SELECT title, url, logo_url AS logo, location, salary FROM jobs_raw
  WHERE source = 'topcv' AND NOT posted UNION ALL SELECT title, url, logo_url, location,
  'Sign-in ITViec for details.' FROM jobs_raw WHERE source = 'itviec' AND NOT posted""")
def p11(spark, sf):
    jobs = jobs_raw(spark, sf)
    return state.unposted(staging_topcv(jobs)).unionByName(state.unposted(staging_itviec(jobs)))


@query("x4_consolidate_sources", JOBS + """SELECT id, source, title, crawled_at FROM jobs_raw WHERE source IS NOT NULL""")
def x4(spark, sf):
    jobs = jobs_raw(spark, sf)
    columns = [*POSTING_TEXT, "crawled_at"]
    parts = [jobs.filter(F.col("source") == s).select(*columns) for s in ("topcv", "itviec", "linkedin")]
    batch = parts[0].unionByName(parts[1]).unionByName(parts[2])
    target = parts[0].filter(F.lit(False)).withColumn("embedding", F.lit(None).cast("array<float>"))
    return state.upsert_jobs(target, batch).select("id", "source", "title", "crawled_at")


# ---- quality ----

FIVE = "array_to_string(list_sort(list(v)), ', ')"


def _check_sql(kind: str, col: str, failing: str, source: str) -> str:
    sample = "''" if kind == "not_null" else f"""coalesce((SELECT {FIVE} FROM (SELECT DISTINCT {col} AS v FROM {source}
  WHERE {failing} ORDER BY v LIMIT 5)), '')"""
    return f"SELECT '{kind}' AS kind, '{col}' AS column, count(*) FILTER ({failing}) AS failures, {sample} AS samples FROM {source}"


def _unique_sql(col: str, source: str) -> str:
    return f"""SELECT 'unique' AS kind, '{col}' AS column, CAST(coalesce(sum(n), 0) AS BIGINT) AS failures,
  coalesce((SELECT {FIVE} FROM (SELECT {col} AS v FROM {source} WHERE {col} IS NOT NULL GROUP BY {col}
    HAVING count(*) > 1 ORDER BY v LIMIT 5)), '') AS samples
  FROM (SELECT count(*) AS n FROM {source} WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) > 1)"""


def _count_sql(low: int, high: int, source: str) -> str:
    return f"""SELECT 'row_count' AS kind, '' AS column, CASE WHEN count(*) BETWEEN {low} AND {high} THEN 0
  ELSE count(*) END AS failures, '' AS samples FROM {source}"""


@query("q1_row_count", JOBS + _count_sql(1, 500, "jobs_raw") + " UNION ALL " + _count_sql(1, 10**9, "jobs_raw"))
def q1(spark, sf):
    checks = [quality.Check("row_count", low=1, high=n) for n in (500, 10**9)]
    return quality.report(jobs_raw(spark, sf), checks)


@query("q2_not_null", JOBS + " UNION ALL ".join(
    _check_sql("not_null", c, f"{c} IS NULL", "jobs_raw") for c in ("url", "title", "company", "requirements")))
def q2(spark, sf):
    checks = [quality.Check("not_null", c) for c in ("url", "title", "company", "requirements")]
    return quality.report(jobs_raw(spark, sf), checks)


@query("q3_unique", JOBS + _unique_sql("url", "jobs_raw") + " UNION ALL " + _unique_sql("company", "jobs_raw"))
def q3(spark, sf):
    return quality.report(jobs_raw(spark, sf), [quality.Check("unique", "url"), quality.Check("unique", "company")])


@query("q4_regex", JOBS + _check_sql("regex", "url", "url IS NOT NULL AND NOT regexp_matches(url, '^https?://')", "jobs_raw")
       + " UNION ALL " + _check_sql("regex", "salary", "salary IS NOT NULL AND NOT regexp_matches(salary, '^[0-9]')", "jobs_raw"))
def q4(spark, sf):
    checks = [quality.Check("regex", "url", pattern="^https?://"), quality.Check("regex", "salary", pattern="^[0-9]")]
    return quality.report(jobs_raw(spark, sf), checks)


@query("q5_accepted_values", JOBS + _check_sql("accepted", "work_model",
       "work_model IS NOT NULL AND work_model NOT IN ('Remote', 'Hybrid', 'On-Site')", "jobs_raw"))
def q5(spark, sf):
    check = quality.Check("accepted", "work_model", values=("Remote", "Hybrid", "On-Site"))
    return quality.report(jobs_raw(spark, sf), [check])


@query("q5_labels_accepted", " UNION ALL ".join([
    _check_sql("accepted", "quality", "quality IS NOT NULL AND quality NOT IN (1)", "labels"),
    _check_sql("accepted", "toxic", "toxic IS NOT NULL AND toxic NOT IN (0, 1)", "labels"),
    _unique_sql("doc_id", "labels")]))
def q5_labels(spark, sf):
    checks = [
        quality.Check("accepted", "quality", values=(1,)), quality.Check("accepted", "toxic", values=(0, 1)),
        quality.Check("unique", "doc_id"),
    ]
    return quality.report(table(spark, sf, "labels"), checks)


@query("q6_gate_report", JOBS + " UNION ALL ".join([
    _count_sql(1, 500, "jobs_raw"),
    *[_check_sql("not_null", c, f"{c} IS NULL", "jobs_raw") for c in ("url", "description", "requirements", "experience")],
    _unique_sql("url", "jobs_raw"),
    _check_sql("regex", "url", "url IS NOT NULL AND NOT regexp_matches(url, '^https?://')", "jobs_raw")]))
def q6(spark, sf):
    rows = jobs_raw(spark, sf).withColumnRenamed("description", "descriptions")
    found = quality.report(rows, quality.TOPCV_CHECKS)
    return found.withColumn("column", F.regexp_replace("column", "^descriptions$", "description"))


# ---- run ledger ----

CLASSIFIED = """classed AS (SELECT *, task_id AS task_name, task_status AS dag_status, CAST(NULL AS VARCHAR) AS task_group,
  'python' AS task_type, CASE WHEN contains(task_id, 'itviec') THEN 'itviec' WHEN contains(task_id, 'topcv') THEN 'topcv'
  WHEN contains(task_id, 'bronze') THEN 'bronze' WHEN contains(task_id, 'silver') THEN 'silver' END AS data_source,
  CASE WHEN contains(task_id, 'bronze') THEN 'bronze' WHEN contains(task_id, 'silver') THEN 'silver' END AS layer
  FROM jobs_audit)"""


@query("f34_ledger_classes", with_(sql.AUDIT_SQL, CLASSIFIED) + """SELECT DISTINCT task_id, task_type, data_source, layer
  FROM classed""")
def f34(spark, sf):
    return audit.classify(jobs_audit(spark, sf)).select("task_id", "task_type", "data_source", "layer").distinct()


ZERO = "CAST(0 AS BIGINT)"


@query("a12_job_elt_summary", with_(sql.AUDIT_SQL, CLASSIFIED) + f"""SELECT task_name,
  CAST(execution_date AS DATE) AS execution_day, dag_status, count(DISTINCT dag_run_id) AS total_dag_runs,
  count(DISTINCT task_id) AS total_tasks, count(*) FILTER (task_status = 'success') AS successful_tasks,
  count(*) FILTER (task_status = 'failed') AS failed_tasks, CAST(sum(rows_processed) AS BIGINT) AS total_rows_processed,
  {ZERO} AS total_rows_inserted, {ZERO} AS total_rows_scraped, {ZERO} AS total_discord_posts_sent,
  {ZERO} AS total_discord_posts_failed, avg(task_duration_seconds) AS avg_dag_duration_seconds,
  min(execution_date) AS first_start_time, max(execution_date) AS last_end_time
  FROM classed GROUP BY task_name, CAST(execution_date AS DATE), dag_status""")
def a12(spark, sf):
    return audit.job_elt_summary(audit.ledger_rows(jobs_audit(spark, sf)))


@query("a13_task_performance", with_(sql.AUDIT_SQL, CLASSIFIED) + """SELECT task_name, task_group, data_source, layer,
  count(*) AS execution_count, count(*) FILTER (task_status = 'success') AS success_count,
  count(*) FILTER (task_status = 'failed') AS failure_count,
  round(count(*) FILTER (task_status = 'success') * 100.0 / count(*), 2) AS success_rate_pct,
  avg(task_duration_seconds) AS avg_duration_seconds, min(task_duration_seconds) AS min_duration_seconds,
  max(task_duration_seconds) AS max_duration_seconds, avg(rows_processed) AS avg_rows_processed,
  max(execution_date) AS last_execution_date FROM classed GROUP BY task_name, task_group, data_source, layer""")
def a13(spark, sf):
    return audit.task_performance(audit.ledger_rows(jobs_audit(spark, sf)))


LEDGER_ROWS_A_TASK = 20_000


@query("u8_ledger_upsert", AUDIT + """SELECT dag_run_id, task_id, execution_date, task_duration_seconds,
  CASE WHEN e % 3 = 0 THEN 'retry' ELSE task_status END AS task_status,
  CASE WHEN e % 3 = 0 THEN 5000 ELSE NULL END AS error_length FROM (
  SELECT a.*, CAST(epoch_us(execution_date) AS BIGINT) AS e FROM jobs_audit a) WHERE e % 2 = 0 OR e % 3 = 0""")
def u8(spark, sf):
    """Half of the rows are in the ledger; a third comes (again) with a new status."""
    rows = jobs_audit(spark, sf).withColumn("e", F.unix_micros(F.col("execution_date").cast("timestamp")))
    empty = F.lit(None).cast("string")
    target = rows.filter("e % 2 = 0").drop("e").withColumn("error_message", empty)
    batch = rows.filter("e % 3 = 0").drop("e").withColumns({
        "task_status": F.lit("retry"), "error_message": F.repeat(F.lit("x"), 6000),
    })
    # Long texts that are much alike take little room in a shuffle and much in memory, so tasks are dealt by rows, not by bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-batch.count() // LEDGER_ROWS_A_TASK))
    merged = state.ledger_upsert(target, batch.repartition(tasks, *LEDGER_KEY))
    return merged.select(
        "dag_run_id", "task_id", "execution_date", "task_duration_seconds", "task_status",
        F.length("error_message").alias("error_length"),
    )
