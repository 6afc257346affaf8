"""Alert digest: due alerts, matching, outbox, cursors and the run summary."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alerts as rules
from ..functions.salary import parse_salary
from ..session import scratch_dir
from .matching import explode_wanted, longest_runs
from .search import labelled


def attach_users(alerts: DataFrame, users: DataFrame) -> DataFrame:
    """Adds the owner's address and blocked flag."""
    owners = users.select("user_id", "email", "is_blocked")
    return alerts.join(owners, "user_id")


def reachable(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.col("is_blocked") & (F.coalesce("email", F.lit("")) != ""))


def due(alerts: DataFrame, as_of: Column) -> DataFrame:
    """Active alerts whose local send hour it is and that were not just sent."""
    return alerts.filter(
        F.col("active") & rules.is_due(F.col("timezone"), F.col("last_sent_at"), as_of)
    )


def sendable(due_alerts: DataFrame, as_of: Column) -> DataFrame:
    """Due alerts that may be sent, with cleaned filters and their cursor."""
    rested = rules.past_cooldown(F.col("last_sent_at"), F.col("created_at"), as_of)
    lookback = as_of - F.expr(f"INTERVAL {rules.LOOKBACK_HOURS} HOURS")
    supported = rules.unsupported_filters(F.col("filters")) == ""
    return reachable(due_alerts).filter(rested & supported).withColumns({
        "wanted": rules.clean_filters(F.col("filters")),
        "cutoff": F.coalesce("last_delivered_job_at", lookback),
    })


def _free(value: Column) -> Column:
    return value.isNull() | (value == "all")


def _runs(text: Column, kind: str) -> Column:
    return F.transform(longest_runs(text), lambda r: F.concat(F.lit(f"{kind}:"), r))


def _facet(place: Column, pay: Column) -> Column:
    return F.concat(F.lit("f:"), place, F.lit("|"), pay)


def _wanted_keys(f: Column) -> Column:
    """The keys that a filter could be found under: runs of its keyword or of a place in words; else its one facet."""
    in_words = ~_free(f["location"]) & (rules.wanted_class(f["location"]) == "free")
    keyword = F.when(F.coalesce(f["keyword"], F.lit("")) != "", _runs(F.lower(f["keyword"]), "k"))
    place = F.when(in_words, _runs(rules.plain_place(f["location"]), "p"))
    location = F.when(_free(f["location"]), F.lit("any")).otherwise(rules.wanted_class(f["location"]))
    facet = _facet(location, F.when(_free(f["salary"]), F.lit("any")).otherwise(f["salary"]))
    none = F.array().cast("array<string>")
    texts = F.array_distinct(F.concat(F.coalesce(keyword, none), F.coalesce(place, none)))
    return F.when(F.size(texts) > 0, texts).otherwise(F.array(facet))


def _facets() -> Column:
    """The facets under which a filter could want a posting."""
    any_ = F.array(F.lit("any"))
    pay = F.concat(any_, F.col("choices"))
    return F.flatten(F.transform(F.concat(any_, F.col("classes")), lambda p: F.transform(pay, lambda s: _facet(p, s))))


def offered(jobs: DataFrame, wanted: DataFrame, only_words: bool = False) -> DataFrame:
    """A row for each posting and each of its keys that is among the wanted ones (column ``key``).

    ``only_words``: the wanted keys are no facets, so places and salaries are not classed.
    """
    def low(c: str) -> Column:
        return F.lower(F.coalesce(c, F.lit("")))

    placed = jobs.withColumn("place", rules.plain_place(F.col("location")))
    texts = [("k:", low("title")), ("k:", low("company")), ("p:", F.coalesce("place", F.lit("")))]
    if only_words:
        return explode_wanted(placed, texts, wanted)
    given = F.coalesce("location", F.lit("")) != ""
    classed = placed.withColumn("_pay", parse_salary(F.col("salary"))).withColumns({
        "classes": F.when(given, rules.classes_of_place(F.col("place"))).otherwise(F.array().cast("array<string>")),
        "choices": rules.choices_of_pay(F.col("salary"), F.col("_pay")),
    }).drop("_pay")
    return explode_wanted(classed, texts, wanted, _facets())


def rarest_keys(filters: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each filter under the one of its keys that fewest postings have (column ``key``).

    Only filters in words have a choice; the frequency table holds their keys and no others.
    """
    could = filters.withColumn("_could", _wanted_keys(F.col("wanted")))
    choices = could.filter(F.size("_could") > 1).select("filter", F.explode("_could").alias("key"))
    asked = choices.select("key").distinct()
    times = offered(jobs.select("title", "company", "location"), asked, only_words=True).groupBy("key").agg(F.count("*").alias("times"))
    counted = choices.join(times, "key", "left")
    rarest = counted.groupBy("filter").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key"))["key"].alias("_rarest"))
    return could.join(rarest, "filter", "left").withColumn("key", F.coalesce("_rarest", F.get("_could", F.lit(0)))).drop("_could", "_rarest")


def _asked(f: Column) -> dict[str, Column]:
    """What a filter asks for, worked out once per filter; null where it asks for nothing."""
    place = F.when(~_free(f["location"]), F.struct(
        rules.wanted_class(f["location"]).alias("kind"), rules.plain_place(f["location"]).alias("words")))
    return {"_keyword": F.lower(f["keyword"]), "_place": place, "_salary": F.when(~_free(f["salary"]), f["salary"])}


def _wanted_by() -> Column:
    """The full predicate over a posting whose classes, and a filter whose wishes are already worked out.

    Filters on other fields never get here: such alerts are not sendable.
    """
    keyword, place, salary = F.col("_keyword"), F.col("_place"), F.col("_salary")
    there = F.array_contains("classes", place["kind"]) & ((place["kind"] != "free") | F.col("place").contains(place["words"]))
    named = F.lower(F.coalesce("title", F.lit(""))).contains(keyword) | F.lower(F.coalesce("company", F.lit(""))).contains(keyword)
    return (keyword.isNull() | named) & (place.isNull() | there) & (salary.isNull() | F.array_contains("choices", salary))


def match_filters(filters: DataFrame, jobs: DataFrame) -> DataFrame:
    """filter, job_id, job_at of every posting that a distinct filter wants.

    A posting only meets filters whose one key it has, in an equality join that Spark can hash, split and
    skew-handle; the full predicate then decides. Where filters have a column ``since``, only later postings count.
    """
    keyed = rarest_keys(filters, jobs).withColumns(_asked(F.col("wanted"))).drop("wanted")
    later = F.col("job_at") > F.col("since") if "since" in filters.columns else F.lit(True)
    pairs = offered(jobs, keyed.select("key").distinct()).join(keyed, "key").filter(later & _wanted_by())
    return pairs.select("filter", "job_id", "job_at")


def oldest_after(found: DataFrame, cutoffs: DataFrame, limit: int) -> DataFrame:
    """filter, cutoff, job_id, job_at, place: the oldest ``limit`` matches of a filter after each of its cutoffs.

    Matches are counted by hour. From the counts follows which hours a cutoff needs: its own, and later ones until
    ``limit`` matches are reached. A cutoff is joined with the matches of these hours only, not with all of its filter.
    """
    hour = F.date_trunc("hour", "job_at")
    hours = found.groupBy("filter", hour.alias("hour")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("filter").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    summed = hours.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    starts = cutoffs.select("filter", F.date_trunc("hour", "cutoff").alias("start")).distinct()
    later = starts.join(summed, "filter").filter("hour >= start")
    first = Window.partitionBy("filter", "start")
    # What lies in the cutoff's own hour may be before it, so only the hours behind it count towards the limit.
    behind = F.min(F.when(F.col("hour") > F.col("start"), F.col("before"))).over(first)
    needed = later.withColumn("skipped", F.coalesce(behind, F.col("before"))).filter(
        (F.col("hour") == F.col("start")) | (F.col("before") - F.col("skipped") < limit)).select("filter", "start", "hour")
    asked = cutoffs.withColumn("start", F.date_trunc("hour", "cutoff")).join(needed, ["filter", "start"]).select("filter", "cutoff", "hour")
    rows = found.withColumn("hour", hour).join(asked, ["filter", "hour"]).filter(F.col("job_at") > F.col("cutoff"))
    oldest = Window.partitionBy("filter", "cutoff").orderBy("job_at", "job_id")
    placed = rows.select("filter", "cutoff", "job_id", "job_at", F.row_number().over(oldest).alias("place"))
    return placed.filter(F.col("place") <= limit)


@dataclass
class Digest:
    """Results of one run: mails to send, new cursors, delivery log, summary."""

    outbox: DataFrame
    cursors: DataFrame
    deliveries: DataFrame
    summary: DataFrame


def earliest_cutoff(due_alerts: DataFrame, as_of: Column) -> datetime:
    """Where scanning starts; a literal, so the scan can skip files by date."""
    lookback = as_of - F.expr(f"INTERVAL {rules.LOOKBACK_HOURS} HOURS")
    bounds = due_alerts.agg(F.least(F.min("last_delivered_job_at"), F.min(lookback), lookback))
    return bounds.first()[0]


def match_alerts(ready: DataFrame, scanned: DataFrame, limit: int = rules.JOBS_PER_MAIL) -> DataFrame:
    """Up to ten postings per alert, oldest first; alerts with equal filters share one matching."""
    wishing = _kept(ready.withColumn("filter", F.to_json(F.struct("wanted.*"))), "alert-wishes")  # read for each step that follows
    filters = wishing.groupBy("filter").agg(F.any_value("wanted").alias("wanted"), F.min("cutoff").alias("since"))
    found = _kept(match_filters(filters, scanned), "alert-matches")
    oldest = oldest_after(found, wishing.select("filter", "cutoff").distinct(), limit)
    lists = oldest.groupBy("filter", "cutoff").agg(
        F.array_sort(F.collect_list(F.struct("job_at", "job_id"))).alias("found"))
    return wishing.join(lists, ["filter", "cutoff"], "left").drop("filter")


def _kept(rows: DataFrame, label: str) -> DataFrame:
    """Stored and read back, for rows that several results are made of."""
    path = scratch_dir(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_digest(
    alerts: DataFrame, raw_jobs: DataFrame, as_of: Column, failed: DataFrame | None = None
) -> Digest:
    """One digest run over alerts that carry their owner's fields.

    ``failed`` lists alert ids whose mail could not be delivered: their cursor
    stays, so the next run offers the same postings again.
    """
    due_alerts = due(alerts, as_of)
    start = F.lit(earliest_cutoff(due_alerts, as_of)).cast("timestamp_ntz")
    scanned = labelled(raw_jobs.filter(F.col("crawled_at") > start)).select(
        F.col("id").alias("job_id"), F.col("created_at").alias("job_at"),
        "title", "company", "location", "salary",
    )
    matched = match_alerts(sendable(due_alerts, as_of), scanned)
    undelivered = F.lit(False)
    if failed is not None:
        lost = failed.select("alert_id", F.lit(True).alias("lost")).distinct()
        matched = matched.join(lost, "alert_id", "left")
        undelivered = F.coalesce("lost", F.lit(False))
    newest_scanned = scanned.agg(F.max("job_at")).scalar()
    state = matched.withColumn("newest_scanned", newest_scanned).select(
        "alert_id", "email", "name", "last_sent_at", "last_delivered_job_at", "cutoff", "wanted",
        F.transform("found", lambda j: j["job_id"]).alias("job_ids"),
        F.array_max(F.transform("found", lambda j: j["job_at"])).alias("newest_match"),
        "newest_scanned", undelivered.alias("failed"),
    )
    state = _kept(state, "digest-state")  # the four results are made of one matching
    has_match = F.col("job_ids").isNotNull()
    sent = has_match & ~F.col("failed")
    moved = (
        F.when(sent, F.col("newest_match"))
        .when(~has_match & (F.col("newest_scanned") > F.col("cutoff")), F.col("newest_scanned"))
        .otherwise(F.col("last_delivered_job_at"))
    )
    outbox = state.filter(has_match).select(
        "alert_id", "email", "name", "job_ids",
        rules.describe_filters(F.col("wanted")).alias("filters_text"),
        F.when(F.col("failed"), F.lit("failed")).otherwise(F.lit("sent")).alias("status"),
    )
    cursors = state.select(
        "alert_id",
        F.when(sent, as_of).otherwise(F.col("last_sent_at")).alias("last_sent_at"),
        moved.alias("last_delivered_job_at"),
    )
    deliveries = state.filter(sent).select("alert_id", as_of.alias("sent_at"), "job_ids")
    counts = state.agg(
        F.count_if(has_match).alias("alerts_with_matches"),
        F.count_if(sent).alias("emails_sent"),
        F.count_if(has_match & F.col("failed")).alias("emails_failed"),
    )
    summary = counts.withColumns({
        "alerts_processed": due_alerts.agg(F.count("*")).scalar(),
        "jobs_scanned": scanned.agg(F.count("*")).scalar(),
    })
    return Digest(outbox, cursors, deliveries, summary)


def apply_cursors(alerts: DataFrame, cursors: DataFrame) -> DataFrame:
    """Alert table after a run."""
    fresh = cursors.select(
        "alert_id", F.col("last_sent_at").alias("_sent"), F.col("last_delivered_job_at").alias("_at"),
        F.lit(True).alias("_ran"),
    )
    joined = alerts.join(fresh, "alert_id", "left")
    ran = F.coalesce("_ran", F.lit(False))
    return joined.withColumns({
        "last_sent_at": F.when(ran, F.col("_sent")).otherwise(F.col("last_sent_at")),
        "last_delivered_job_at": F.when(ran, F.col("_at")).otherwise(F.col("last_delivered_job_at")),
    }).select(*alerts.columns)
