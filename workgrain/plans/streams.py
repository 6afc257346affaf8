"""Streams over the given tables, run until they have caught up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import warehouse as wh
from ..session import scratch_dir
from ..streaming import jobs as streams
from . import sql
from .fixtures import JOBS_RAW, LAYOUTS, _items, as_of, staging_topcv, table
from .registry import query
from .sql import JOBS, with_
from .state import DIGEST, NOW, owned


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return streams.read_files(spark, sf, LAYOUTS[name], f"{name}.parquet")


FILE_ROWS = 500_000


def shuffled_stream(spark: SparkSession, sf: str, name: str, batches: int = 4) -> DataFrame:
    """The table as several files whose rows are in no time order, worked off in ``batches`` micro-batches.

    A micro-batch has as many files as its rows need, so that no task writes or reads more than about FILE_ROWS.
    """
    path = scratch_dir(spark, f"{name}-files")
    rows = table(spark, sf, name)
    each = max(1, -(-rows.count() // (batches * FILE_ROWS)))
    rows.repartition(batches * each, F.xxhash64(*rows.columns)).write.parquet(path)
    return streams.read_files(spark, path, rows.schema, "part-*", per_trigger=each)


def posting_stream(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = shuffled_stream(spark, sf, "orders"), table(spark, sf, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(*_items(JOBS_RAW))


@query("t1_incremental_ingest", with_(sql.JOBS_SQL, *sql.BRONZE_SQL)
       + "SELECT id, url, title, salary, created_at FROM bronze_topcv WHERE url IS NOT NULL")
def t1(spark, sf):
    root = scratch_dir(spark, "ingest")
    rows = wh.bronze_topcv(staging_topcv(posting_stream(spark, sf)))
    sink = streams.ingest_into(f"{root}/table", "url", [F.desc("created_at"), "id"])
    streams.run(rows, sink, f"{root}/checkpoint")
    return streams.ingested(spark, f"{root}/table", "url").read().select("id", "url", "title", "salary", "created_at")


@query("t2_first_seen_dedup", """SELECT 'https://jobs.example/' || l_orderkey AS url, min(l_shipdate) AS first_seen
  FROM lineitem GROUP BY ALL""")
def t2(spark, sf):
    root = scratch_dir(spark, "first-seen")
    rows = shuffled_stream(spark, sf, "lineitem").select(
        F.concat(F.lit("https://jobs.example/"), "l_orderkey").alias("url"), F.col("l_shipdate").alias("first_seen")
    )
    streams.run(rows, streams.first_seen_into(f"{root}/urls", "url", "first_seen"), f"{root}/checkpoint")
    return streams.first_seen(spark, f"{root}/urls", "url", "first_seen")


@query("t3_daily_counts", JOBS + """SELECT CAST(crawled_at AS DATE) AS day, source, count(*) AS total_jobs
  FROM jobs_raw GROUP BY ALL""")
def t3(spark, sf):
    root = scratch_dir(spark, "daily-counts")
    rows = posting_stream(spark, sf).select("crawled_at", "source")
    streams.run(rows, streams.daily_counts_into(f"{root}/counts", "crawled_at", "source"), f"{root}/checkpoint")
    return streams.daily_counts(spark, f"{root}/counts", "source")


@query("t4_alert_cursor", with_(*(c.replace("'al-8'", "''") for c in DIGEST)) + f"""SELECT a.alert_id,
  CASE WHEN p.job_ids IS NOT NULL THEN {NOW} ELSE a.last_sent_at END AS last_sent_at,
  CASE WHEN p.job_ids IS NOT NULL THEN p.newest
    WHEN r.alert_id IS NOT NULL AND (SELECT max(crawled_at) FROM scanned) > cutoff THEN (SELECT max(crawled_at) FROM scanned)
    ELSE a.last_delivered_job_at END AS last_delivered_job_at
  FROM alerts a LEFT JOIN ready r ON r.alert_id = a.alert_id LEFT JOIN per_alert p ON p.alert_id = a.alert_id""")
def t4(spark, sf):
    from ..operators.digest import attach_users

    root = scratch_dir(spark, "digest")
    alerts = attach_users(*owned(spark, sf))
    streams.run(posting_stream(spark, sf), streams.append_to(f"{root}/postings"), f"{root}/checkpoint")
    stored = streams.digest_stored(spark, root, alerts, as_of())
    return stored.select("alert_id", "last_sent_at", "last_delivered_job_at")


LIMIT, SECONDS = 3, 86_400
OPENED = f"""RECURSIVE opened(user_id, ts) AS (SELECT user_id, min(ts) FROM events GROUP BY user_id
  UNION ALL SELECT * FROM (SELECT o.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = o.user_id
    AND e.ts >= o.ts + INTERVAL {SECONDS} SECOND) AS ts FROM opened o) WHERE ts IS NOT NULL)"""


@query("t5_fixed_window_quota", with_(OPENED) + f"""SELECT user_id, event_id, place <= {LIMIT} AS allowed,
  CAST(greatest(0, {LIMIT} - place) AS INTEGER) AS remaining FROM (SELECT e.user_id, e.event_id,
  row_number() OVER (PARTITION BY e.user_id, o.ts ORDER BY e.ts, e.event_id) AS place
  FROM events e ASOF JOIN opened o ON e.user_id = o.user_id AND e.ts >= o.ts)""")
def t5(spark, sf):
    root = scratch_dir(spark, "quota")
    sink = streams.quota_into(f"{root}/quota", "user_id", "ts", "event_id", LIMIT, SECONDS)
    streams.run(stream_of(spark, sf, "events"), sink, f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/quota/events").drop("batch")


@query("t6_hourly_idempotency", """SELECT date_trunc('hour', ts) AS hour, user_id, min(event_id) AS event_id
  FROM events GROUP BY ALL""")
def t6(spark, sf):
    root = scratch_dir(spark, "deliveries")
    attempts = stream_of(spark, sf, "events").select(
        streams.hour_bucket(F.col("ts")).alias("hour"), "user_id", "event_id"
    )
    streams.run(attempts, streams.deliver_once(f"{root}/sent", ["hour", "user_id"], ["event_id"]), f"{root}/checkpoint")
    return spark.read.parquet(f"{root}/sent").select("hour", "user_id", "event_id")
