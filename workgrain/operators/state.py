"""State tables: upserts, first-seen inserts, delivery flags and incremental loads.

Merges are written so that the large target is not shuffled for a small batch:
the target meets the batch in a left join, where Spark broadcasts the batch when
it is small, and only the keys both sides share are looked up for the inserts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_at, last_segment
from ..schemas import LEDGER_CAPS, LEDGER_KEY, LEDGER_REFRESHED, POSTING_TEXT, SEMANTIC_FIELDS


def dedup(batch: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the given total order; rows without a key drop out."""
    first = Window.partitionBy(key).orderBy(*order)
    keyed = batch.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    return keyed.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def one_per_key(
    batch: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, last: bool = True,
    first_of: Sequence[str] = (),
) -> DataFrame:
    """One row per key: the last (or first) one by ``order``, by default by the row's values, column by column.

    A table has no order of its own, so a batch in which later rows count must carry a column that says so. Columns in ``first_of`` take the key's first value that is not null. Rows with a null key stay as they
    are: no other row has their key. Rows of a key are reduced per task before the shuffle.
    """
    keys, columns = list(keys), batch.columns
    sort_by = [F.col(c) for c in order or columns]
    placed = batch.withColumn("_order", F.struct(*[o.alias(f"_{i}") for i, o in enumerate(sort_by)]))
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    pick = F.max_by if last else F.min_by
    kept = [
        F.min_by(F.when(F.col(c).isNotNull(), F.struct(c)), F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c)
        for c in first_of
    ]
    others = [c for c in columns if c not in keys and c not in first_of]
    if order is None:  # the row is its own order: one copy of its texts is enough
        chosen = (F.max if last else F.min)(F.struct(*columns))
    else:
        chosen = pick(F.struct(*(others or keys)), "_order")
    single = placed.filter(keyed).groupBy(*keys).agg(chosen.alias("_row"), *kept)
    # The keys stay the grouping's own columns, so a batch that is dealt by its keys is not dealt again.
    rows = single.select(*[F.col(c)[c].alias(c) if c in first_of else F.col("_row")[c].alias(c) if c in others else F.col(c) for c in columns])
    return rows.unionByName(batch.filter(~keyed))


def merge(
    target: DataFrame, batch: DataFrame, keys: Sequence[str],
    on_match: dict[str, Callable[[Column, Column], Column]],
    order: Sequence[str] | None = None, first_of: Sequence[str] = (),
) -> DataFrame:
    """Target after the batch: matched rows change by ``on_match`` (old, new), the
    rest stays, unmatched batch rows are added; columns the batch lacks start as
    null. A key that the batch repeats counts as by ``one_per_key``: the last row
    by ``order`` wins, except for the first values of ``first_of``."""
    keys = list(keys)
    batch = one_per_key(batch, keys, order, first_of=first_of)
    absent = [c for c in target.columns if c not in batch.columns]
    batch = batch.withColumns({c: F.lit(None).cast(target.schema[c].dataType) for c in absent})
    batch = batch.select(*target.columns)
    fresh = batch.select(*keys, F.struct(*batch.columns).alias("_new"))
    joined = target.join(fresh, keys, "left")
    hit = F.col("_new").isNotNull()
    columns = [
        F.when(hit, on_match[c](F.col(c), F.col("_new")[c])).otherwise(F.col(c)).alias(c)
        if c in on_match else F.col(c)
        for c in target.columns
    ]
    return joined.select(*columns).unionByName(absent_rows(target, batch, keys))


def absent_rows(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Batch rows whose key the target lacks. The shared keys are at most as many
    as the batch has, so the second join stays small however large the target is."""
    keys = list(keys)
    shared = target.select(*keys).join(batch.select(*keys), keys, "left_semi")
    return batch.join(shared, keys, "left_anti")


def _take_new(old: Column, new: Column) -> Column:
    return new


def upsert_jobs(target: DataFrame, batch: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Canonical upsert by id: texts are overwritten, the first crawl time stays,
    and the vector is dropped when a field it was made from has changed. Of a
    repeated id the last row by ``order`` wins."""
    fields = F.struct(*[F.col(c) for c in SEMANTIC_FIELDS])
    fresh = F.struct(*[F.col("_new")[c].alias(c) for c in SEMANTIC_FIELDS])
    rules = {c: _take_new for c in POSTING_TEXT}
    rules["crawled_at"] = F.coalesce
    rules["embedding"] = lambda old, new: F.when(fields.eqNullSafe(fresh), old)
    first_of = [c for c in ("crawled_at",) if c in batch.columns]
    return merge(target, batch, ["id"], rules, order, first_of)


def upsert(
    target: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Insert or overwrite the named columns by key; all other columns are kept."""
    return merge(target, batch, [key], {c: _take_new for c in columns}, order)


def insert_new(
    target: DataFrame, batch: DataFrame, key: str, order: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Existing keys stay untouched, of a repeated new key the first row counts;
    also returns the rows that were new."""
    inserted = absent_rows(target, one_per_key(batch, [key], order, last=False), [key])
    return target.unionByName(inserted, allowMissingColumns=True), inserted


def high_water_mark(target: DataFrame, column: str):
    """Newest value, as a literal so that the source scan can push the filter down."""
    return target.agg(F.max(column)).first()[0]


def newer_than(source: DataFrame, column: str, mark) -> DataFrame:
    if mark is None:
        return source
    return source.filter(F.col(column) > F.lit(mark).cast(source.schema[column].dataType))


def bronze_incremental(
    source: DataFrame, target: DataFrame, project: Callable[[DataFrame], DataFrame],
    key: str = "url", column: str = "created_at",
) -> DataFrame:
    """Rows newer than the target, projected and merged by key.

    Rows that arrive late with an older time are missed, as the mark implies;
    ``streaming.ingest`` keeps them.
    """
    batch = project(newer_than(source, column, high_water_mark(target, column)))
    newest = dedup(batch, key, [F.desc(column), "id"])
    return merge(target, newest, [key], {c: _take_new for c in target.columns if c != key})


def mark_posted(rows: DataFrame, sent: DataFrame) -> DataFrame:
    """Sets the flag of the delivered urls only."""
    urls = sent.select("url", F.lit(True).alias("_sent")).distinct()
    joined = rows.join(urls, "url", "left")
    flag = F.coalesce("_sent", F.col("posted_to_discord"))
    return joined.withColumn("posted_to_discord", flag).select(*rows.columns)


def unposted(rows: DataFrame) -> DataFrame:
    """Rows still to be sent; a source without salaries shows a placeholder."""
    salary = F.col("salary") if "salary" in rows.columns else F.lit("Sign-in ITViec for details.")
    waiting = rows.filter(~F.col("posted_to_discord"))
    return waiting.select(
        "title", "url", F.col("logo_url").alias("logo"),
        F.col("working_location").alias("location"), salary.alias("salary"),
    )


def distinct_logos(*staging: DataFrame) -> DataFrame:
    urls = [s.select("logo_url").filter(F.coalesce("logo_url", F.lit("")) != "") for s in staging]
    return reduce(DataFrame.union, urls).distinct()


def new_logos(known: DataFrame, *staging: DataFrame) -> DataFrame:
    """Logo urls of any staging table that the registry lacks."""
    return absent_rows(known, distinct_logos(*staging), ["logo_url"])


def register_logos(known: DataFrame, *staging: DataFrame) -> DataFrame:
    fresh = new_logos(known, *staging).withColumn("logo_id", F.md5("logo_url"))
    return known.unionByName(fresh, allowMissingColumns=True)


def store_logos(known: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """Registry after downloads: path, flag and time of the stored logos."""
    done = stored.withColumns({
        "logo_id": F.md5("logo_url"), "is_downloaded": F.lit(True), "updated_at": as_of,
    })
    return upsert(known, done, "logo_url", ["logo_id", "logo_path", "is_downloaded", "updated_at"])


def candidates(urls: DataFrame, jobs: DataFrame, n: int = 40) -> DataFrame:
    """Next urls to crawl: unknown ids only, in url order."""
    found = urls.select("url").distinct().withColumn("id", last_segment(F.col("url")))
    return absent_rows(jobs.select("id"), found, ["id"]).orderBy("url").limit(n)


def dedup_cleaned_urls(rows: DataFrame) -> DataFrame:
    """Repair of rows that differ by tracking suffix only: the lowest id stays."""
    cleaned = rows.withColumn("url", F.trim(cut_at(F.col("url"), "?ta_source")))
    return dedup(cleaned, "url", ["id"])


def ledger_upsert(target: DataFrame, rows: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Run-ledger merge: a known key refreshes some columns, error texts are cut."""
    cuts = {c: F.substring(c, 1, n) for c, n in LEDGER_CAPS.items() if c in rows.columns}
    refreshed = [c for c in LEDGER_REFRESHED if c in target.columns]
    return merge(target, rows.withColumns(cuts), LEDGER_KEY, {c: _take_new for c in refreshed}, order)
