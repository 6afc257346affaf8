"""Streams over several files, one file per micro-batch, equal their batch twins."""

from __future__ import annotations

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from workgrain.operators import digest, state
from workgrain.operators import warehouse as wh
from workgrain.plans import fixtures
from workgrain.streaming import jobs as streams

SMALL = "/root/testdata/sf0.001"


def split(rows, path, parts, order=None):
    """Writes the rows as ``parts`` files: in the order of a column, or dealt by hash, so in no time order."""
    if isinstance(order, str) and order.startswith("-"):
        order = F.desc(order[1:])
    dealt = rows.repartition(parts, F.xxhash64(*rows.columns)) if order is None else rows.repartitionByRange(parts, order)
    dealt.write.parquet(path)
    for age, name in enumerate(sorted(Path(path).glob("part-*"))):
        os.utime(name, (age + 1, age + 1))
    return path


def stream(spark, path, schema):
    return streams.read_files(spark, path, schema, per_trigger=1)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_ingest_keeps_late_rows(spark, tmp_path):
    staging = fixtures.staging_topcv(fixtures.jobs_raw(spark, SMALL)).filter("url is not null")
    path = split(staging, f"{tmp_path}/in", 3, F.desc("created_at"))
    rows = wh.bronze_topcv(stream(spark, path, staging.schema))
    sink = streams.ingest_into(f"{tmp_path}/t", "url", [F.desc("created_at"), "id"])
    streams.run(rows, sink, f"{tmp_path}/c")
    table = streams.ingested(spark, f"{tmp_path}/t", "url")
    stored = table.read()
    assert rows_of(stored.select("id", "title")) == rows_of(wh.bronze_topcv(staging).select("id", "title"))
    assert len(table.versions()) == 3
    streams.run(rows, sink, f"{tmp_path}/c")
    assert len(table.versions()) == 3


@pytest.mark.parametrize("order", [None, "at", "-at"])
def test_first_seen_across_batches(spark, tmp_path, order):
    rows = fixtures.table(spark, SMALL, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("url"), F.col("l_shipdate").alias("at")
    )
    path = split(rows, f"{tmp_path}/in", 4, order)
    sink = streams.first_seen_into(f"{tmp_path}/out", "url", "at")
    streams.run(stream(spark, path, rows.schema), sink, f"{tmp_path}/c")
    sink(spark.read.parquet(path).limit(0), 9)
    got = streams.first_seen(spark, f"{tmp_path}/out", "url", "at")
    assert rows_of(got) == rows_of(rows.groupBy("url").agg(F.min("at").alias("at")))


@pytest.mark.parametrize("order", [None, "-at"])
def test_daily_counts_equal_batch(spark, tmp_path, order):
    rows = fixtures.jobs_raw(spark, SMALL).select(F.col("crawled_at").alias("at"), "source")
    path = split(rows, f"{tmp_path}/in", 4, order)
    sink = streams.daily_counts_into(f"{tmp_path}/out", "at", "source")
    streams.run(stream(spark, path, rows.schema), sink, f"{tmp_path}/c")
    got = streams.daily_counts(spark, f"{tmp_path}/out", "source")
    want = rows.groupBy(F.to_date("at").alias("day"), "source").count()
    assert rows_of(got) == rows_of(want)


def quota_by_hand(events, limit, seconds):
    used, ends, out = {}, {}, {}
    for user, at, ident in sorted(events, key=lambda e: (e[1], e[2])):
        if user not in ends or (at - ends[user]).total_seconds() >= seconds:
            ends[user], used[user] = at, 0
        used[user] += 1
        out[ident] = used[user] <= limit
    return out


def decided(spark, path):
    rows = spark.read.parquet(f"{path}/events").collect()
    got = {r["event_id"]: r["allowed"] for r in rows}
    assert len(got) == len(rows)
    return got


def test_quota_over_batches(spark, tmp_path):
    events = fixtures.table(spark, SMALL, "events").select("user_id", "ts", "event_id")
    path = split(events, f"{tmp_path}/in", 4, "ts")
    sink = streams.quota_into(f"{tmp_path}/q", "user_id", "ts", "event_id", 2, 86_400)
    streams.run(stream(spark, path, events.schema), sink, f"{tmp_path}/c")
    got = decided(spark, f"{tmp_path}/q")
    assert got == quota_by_hand([tuple(r) for r in events.collect()], 2, 86_400)
    assert len(set(got.values())) == 2


@pytest.mark.parametrize("seconds, limit", [(3_600, 3), (86_400, 40), (1_000_000, 1), (60, 0)])
def test_quota_of_a_single_key(spark, tmp_path, seconds, limit):
    """One key has all rows: few of its events reach the step that knows the whole key, and the batches make no difference."""
    events = fixtures.table(spark, SMALL, "events").select(F.lit(None).cast("string").alias("user"), "ts", "event_id")
    path = split(events, f"{tmp_path}/in", 3, "ts")
    sink = streams.quota_into(f"{tmp_path}/q", "user", "ts", "event_id", limit, seconds, grains=16)
    streams.run(stream(spark, path, events.schema), sink, f"{tmp_path}/c")
    want = quota_by_hand([tuple(r) for r in events.collect()], limit, seconds)
    assert decided(spark, f"{tmp_path}/q") == want
    last = spark.read.parquet(*sorted(str(p) for p in Path(f"{tmp_path}/in").glob("part-*"))[-1:])
    sink(last, 2)
    assert decided(spark, f"{tmp_path}/q") == want


def test_quota_state_ends_with_its_window(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 5, 2), ("b", 7, 3), (None, 8, 4), ("a", None, 5), ("a", 30, 6), ("a", 31, 7), ("c", 200, 8)]
    df = spark.createDataFrame(rows, "key string, s long, n long").withColumn("ts", F.timestamp_seconds("s"))
    sink = streams.quota_into(f"{tmp_path}/q", "key", "ts", "n", 1, 10)
    state_after = lambda i: [tuple(r) for r in streams.quota_state(spark, f"{tmp_path}/q", df.select("key").schema, i).orderBy("opened").collect()]
    sink(df.filter("n <= 5"), 0)
    assert len(state_after(0)) == 3 and ("a", 0, 2) in state_after(0)
    sink(df.filter("n IN (6, 7)"), 1)
    assert state_after(1) == [("a", 30_000_000, 2)]
    sink(df.filter("n = 8"), 2)
    assert state_after(2) == [("c", 200_000_000, 1)]
    sink(df.limit(0), 3)
    assert state_after(3) == [("c", 200_000_000, 1)]
    got = {r.n: (r.allowed, r.remaining) for r in spark.read.parquet(f"{tmp_path}/q/events").collect()}
    yes, no = (True, 0), (False, 0)
    assert got == {1: yes, 2: no, 3: yes, 4: yes, 5: (None, None), 6: yes, 7: no, 8: yes}


def test_few_events_are_unsure():
    times = np.unique(np.random.default_rng(3).integers(0, 1_000_000, 200_000))
    grains = times // 25
    lows, highs = (f.reduceat(times, np.flatnonzero(np.diff(grains, prepend=-1))) for f in (np.minimum, np.maximum))
    marked = streams.unsure_grains(lows, highs, None, 100_000)
    kept = np.unique(np.concatenate([lows, times[np.isin(grains, lows[marked] // 25)]]))
    assert streams.window_starts(kept, None, 100_000) == streams.window_starts(times, None, 100_000)
    assert np.isin(grains, lows[marked] // 25).mean() < 0.01


def test_quota_third_call_is_refused(spark, tmp_path):
    calls = spark.createDataFrame([("k", i) for i in range(3)], "key string, n int").withColumn(
        "ts", F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, n)")
    )
    calls.coalesce(1).write.parquet(f"{tmp_path}/in")
    sink = streams.quota_into(f"{tmp_path}/q", "key", "ts", "n", 2, 60)
    streams.run(stream(spark, f"{tmp_path}/in", calls.schema), sink, f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/q/events").orderBy("n").collect()
    assert [(r.allowed, r.remaining) for r in got] == [(True, 1), (True, 0), (False, 0)]


def test_deliver_once_per_hour(spark, tmp_path):
    events = fixtures.table(spark, SMALL, "events").select("user_id", "ts", "event_id")
    path = split(events, f"{tmp_path}/in", 4, F.col("event_id") % 4)
    keyed = stream(spark, path, events.schema).withColumn("hour", streams.hour_bucket(F.col("ts")))
    streams.run(keyed, streams.deliver_once(f"{tmp_path}/out", ["hour", "user_id"], ["event_id"]), f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/out").select("hour", "user_id")
    want = events.select(streams.hour_bucket(F.col("ts")).alias("hour"), "user_id").distinct()
    assert rows_of(got) == rows_of(want)


def test_digest_does_not_depend_on_batches(spark, tmp_path):
    root = "/root/testdata/sf0.01"
    alerts = fixtures.alerts(spark, root)
    jobs = fixtures.jobs_raw(spark, root).filter("crawled_at > timestamp_ntz '2001-07-01 00:00:00'")
    batch = digest.run_digest(alerts, jobs, fixtures.as_of())
    key = lambda r: str(tuple(r))
    want = sorted(digest.apply_cursors(alerts, batch.cursors).select("alert_id", "last_delivered_job_at").collect(), key=key)
    sent = sorted(batch.deliveries.select("alert_id", "job_ids").collect(), key=key)
    path = split(jobs, f"{tmp_path}/in", 3)
    streams.run(stream(spark, path, jobs.schema), streams.append_to(f"{tmp_path}/d/postings"), f"{tmp_path}/c")
    got = streams.digest_stored(spark, f"{tmp_path}/d", alerts, fixtures.as_of())
    assert sorted(got.select("alert_id", "last_delivered_job_at").collect(), key=key) == want
    told = spark.read.parquet(f"{tmp_path}/d/deliveries").select("alert_id", "job_ids")
    assert sorted(told.collect(), key=key) == sent and sent
    again = streams.digest_stored(spark, f"{tmp_path}/d", alerts, fixtures.as_of())
    assert spark.read.parquet(f"{tmp_path}/d/deliveries").count() == len(sent) and again.count() == len(want)
