"""Structured Streaming forms of the incremental steps.

Every sink is written per micro-batch under its batch number, so a batch that
Spark repeats after a lost executor or driver replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DateType, IntegerType, LongType, StructField, StructType

from ..operators import digest, state
from ..sources.keyed import KeyedTable

BatchSink = Callable[[DataFrame, int], None]


def read_files(
    spark: SparkSession, path: str, schema: str, pattern: str = "*.parquet", per_trigger: int = 100
) -> DataFrame:
    """Parquet files as a stream; ``per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return reader.option("maxFilesPerTrigger", per_trigger).parquet(path)


def run(stream: DataFrame, sink: BatchSink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there and stops; a later run goes on where this one ended."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_to(path: str) -> BatchSink:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def ingest_into(
    root: str, key: str, order: Sequence[str | Column], keep: Sequence[str] = ("created_at",), buckets: int = 16
) -> BatchSink:
    """Keyed upsert of every batch into a keyed table; late rows arrive as well.

    ``keep`` lists columns whose first value stays. A commit notes its batch, so a batch that Spark repeats is
    not applied twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        table = ingested(batch.sparkSession, root, key, buckets)
        if table.version() is not None and table.note() >= number:
            return

        def change(held: DataFrame | None, rows: DataFrame) -> DataFrame:
            columns = [c for c in rows.columns if c != key and c not in keep]
            return rows if held is None else state.upsert(held, rows, key, columns)

        table.apply(state.dedup(batch, key, order), change, note=number)

    return write


def ingested(spark: SparkSession, root: str, key: str, buckets: int = 16) -> KeyedTable:
    """The table that ``ingest_into`` keeps."""
    return KeyedTable(spark, root, [key], buckets)


def first_seen_into(path: str, key: str, event_time: str) -> BatchSink:
    """Earliest time per key of every batch, under the batch's number."""

    def write(batch: DataFrame, number: int) -> None:
        seen = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(event_time).alias(event_time))
        append_to(path)(seen, number)

    return write


def first_seen(spark: SparkSession, path: str, key: str, event_time: str) -> DataFrame:
    """Every key with its earliest time over all batches, whatever order they came in."""
    return spark.read.parquet(path).groupBy(key).agg(F.min(event_time).alias(event_time))


def daily_counts_into(path: str, event_time: str, group: str) -> BatchSink:
    """Rows per day and group of every batch, under the batch's number.

    The counts of the batches are added up when they are read, so a row counts
    however late it comes: there is no watermark that could drop it.
    """

    def write(batch: DataFrame, number: int) -> None:
        day = F.to_date(event_time).alias("day")
        append_to(path)(batch.groupBy(day, group).agg(F.count("*").alias("total_jobs")), number)

    return write


def daily_counts(spark: SparkSession, path: str, group: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("day", group).agg(F.sum("total_jobs").alias("total_jobs"))


def digest_stored(spark: SparkSession, root: str, alerts: DataFrame, as_of: Column, buckets: int = 16) -> DataFrame:
    """One digest run over all postings landed below ``root``, from every alert's own cursor.

    Postings are landed by ``append_to(root + "/postings")``; how they were split into batches
    makes no difference, and matches beyond one mail wait in the stored postings for the next run.
    Deliveries are written first, then the cursors of the alerts that took part. Returns the alerts after the run.
    """
    table = KeyedTable(spark, f"{root}/alerts", ["alert_id"], buckets)
    if table.version() is None:
        table.apply(alerts, lambda held, batch: batch)
    stored = table.read()
    result = digest.run_digest(stored, spark.read.parquet(f"{root}/postings").drop("batch"), as_of)
    result.deliveries.write.mode("overwrite").parquet(f"{root}/deliveries/run={table.version() + 1}")
    table.apply(result.cursors, digest.apply_cursors)
    return table.read()


def deliver_once(root: str, keys: Sequence[str], order: Sequence[str], hour: str = "hour") -> BatchSink:
    """Keeps the first row per key over all batches: keys delivered before drop out.

    ``hour``, one of the keys, is the time a delivery is for. What is delivered is stored by day, so a batch reads the
    stored keys of the days it has rows for, and not the history; days that nothing more comes for can be removed.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        first = Window.partitionBy(*keys).orderBy(*order)
        fresh = batch.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")
        fresh = fresh.withColumn("day", F.to_date(hour))
        if number > 0:
            low, high = batch.agg(F.min(F.to_date(hour)), F.max(F.to_date(hour))).first()
            before = delivered(spark, root, batch.schema).filter(F.col("day").between(F.lit(low), F.lit(high)) & (F.col("batch") < number))
            fresh = fresh.join(before.select(*keys), list(keys), "left_anti")
        placed = fresh.withColumn("batch", F.lit(number))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(root)

    return write


def delivered(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """What ``deliver_once`` has kept, with the day and batch it is stored under."""
    return spark.read.schema(StructType([*schema.fields, StructField("day", DateType()), StructField("batch", IntegerType())])).parquet(root)


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


def quota_into(
    root: str, key: str, event_time: str, ident: str, limit: int, seconds: int, grains: int = 4096, late: int = 0
) -> BatchSink:
    """Whether each event is inside its key's quota: ``limit`` events per window.

    A window opens with a key's first event and ends ``seconds`` later; the next event opens the next one.
    Decisions go to ``root/events``, by batch number. Events come in time order from one batch to the next,
    in any order inside a batch; one that is older than its key's open window counts in that window. An event
    without a time is not counted and its decision is null; a null key is a key.

    No step holds a key's events in one task. Where windows open is found from the first and last event of every
    grain (a ``grains``-th of a window): what a key sends to one task grows with its windows, and with the events of
    those grains in which an opening cannot be told from the grain's ends. The events then meet their window in an
    equality join, and only the first ``limit`` of a window are numbered.

    The open windows after a batch are stored in one of two slots that take turns, so a batch that Spark repeats
    finds what it started from. A window that ended ``late`` seconds before the batch's newest event is dropped.
    """
    span, grain = seconds * 1_000_000, max(1, seconds * 1_000_000 // grains)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        micros = F.unix_micros(F.col(event_time).cast("timestamp"))
        rows = batch.select(F.col(key).alias("k"), F.col(ident).alias("i"), micros.alias("at"))
        held = quota_state(spark, root, rows.select("k").schema, number - 1)
        start = F.greatest("at", "opened")
        known = rows.join(held, rows.k.eqNullSafe(held.k), "left").select(rows.k, "i", "at", "opened", "used", start.alias("start"))
        known.write.mode("overwrite").parquet(f"{root}/rows")
        events = spark.read.schema(known.schema).parquet(f"{root}/rows")
        timed = events.filter("at IS NOT NULL")

        found = _window_cells(_openers(timed, span, grain), span)
        found.write.mode("overwrite").parquet(f"{root}/windows")
        windows = spark.read.schema(found.schema).parquet(f"{root}/windows")
        same = timed.k.eqNullSafe(windows.k) & (_floor_div("start", span) == windows.cell)
        opener = F.when(F.col("start") >= F.col("own"), F.col("own")).otherwise(F.col("before"))
        placed = timed.join(windows, same).select(timed.k, "i", "at", opener.alias("opener"),
            F.when(opener == F.col("opened"), F.col("used")).otherwise(F.lit(0)).alias("used"))

        first = Window.partitionBy("k", "opener").orderBy("at", "i")
        top = placed.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= limit)
        cuts = top.filter(F.col("place") == limit).select(
            F.col("k").alias("cut_k"), F.col("opener").alias("cut_opener"), F.struct("at", "i").alias("cut"))
        met = placed.join(cuts, placed.k.eqNullSafe(cuts.cut_k) & (placed.opener == cuts.cut_opener), "left")
        beyond = F.coalesce(F.struct("at", "i") > F.col("cut"), F.lit(False))
        near = met.filter(~beyond).withColumn("place", F.col("used") + F.row_number().over(first))
        parts = [near, met.filter(beyond).withColumn("place", F.lit(limit + 1)),
                 events.filter("at IS NULL").withColumn("place", F.lit(None).cast("long"))]
        decided = [p.select(
            F.col("k").alias(key), F.col("i").alias(ident), (F.col("place") <= limit).alias("allowed"),
            F.when(F.col("place").isNotNull(), F.greatest(F.lit(0), F.lit(limit) - F.col("place"))).cast("int").alias("remaining"),
        ) for p in parts]
        append_to(f"{root}/events")(reduce(DataFrame.unionByName, decided), number)

        newest = timed.agg(F.max("at")).first()[0]
        counted = placed.groupBy("k", "opener").agg((F.max("used") + F.count("*")).alias("used"))
        ended = F.lit(False) if newest is None else F.col("opened") + span + late * 1_000_000 <= newest
        latest = held.unionByName(counted.withColumnRenamed("opener", "opened")).groupBy("k").agg(
            F.max(F.struct("opened", "used")).alias("last")).select("k", "last.*").filter(~ended)
        latest.withColumn("after", F.lit(number)).write.mode("overwrite").parquet(f"{root}/state/slot-{number % 2}")

    return write


def quota_state(spark: SparkSession, root: str, key: StructType, number: int) -> DataFrame:
    """Open windows after a batch: the key as ``k``, when the window opened (microseconds) and how many events it has."""
    layout = StructType([StructField("k", key.fields[0].dataType), StructField("opened", LongType()),
                         StructField("used", LongType()), StructField("after", IntegerType())])
    if number < 0:
        return spark.createDataFrame([], layout).drop("after")
    stored = spark.read.schema(layout).parquet(f"{root}/state/slot-{number % 2}")
    return stored.filter(F.col("after") == number).drop("after")


def _floor_div(column: str, by: int) -> Column:
    return (F.col(column) - F.pmod(F.col(column), F.lit(by))) / by


def _openers(timed: DataFrame, span: int, grain: int) -> DataFrame:
    """Every window that events of the batch are in: key and opening time, the open ones from before included."""
    grained = timed.withColumn("grain", _floor_div("start", grain).cast("long"))
    ends = grained.groupBy("k", "opened", "grain").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    key = timed.schema["k"].dataType.simpleString()

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _key_runs(batches):
            marked = unsure_grains(run["low"].to_numpy(), run["high"].to_numpy(), run["opened"][0].as_py(), span)
            yield from run.select(["k", "grain"]).filter(pa.array(marked)).to_batches()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _key_runs(batches):
            found = window_starts(run["low"].to_numpy(), run["opened"][0].as_py(), span)
            names = run["k"].take(pa.array(np.zeros(len(found), dtype=np.int64)))
            yield from pa.table({"k": names, "opener": pa.array(found, pa.int64())}).to_batches()

    asked = ends.repartition("k").sortWithinPartitions("k", "grain").mapInArrow(unsure, f"k2 {key}, grain2 long")
    inside = grained.join(asked, grained.k.eqNullSafe(asked.k2) & (grained.grain == asked.grain2), "left_semi")
    times = ends.select("k", "opened", "low").union(inside.select("k", "opened", F.col("start").alias("low")))
    return times.repartition("k").sortWithinPartitions("k", "low").mapInArrow(chain, f"k {key}, opener long")


def _key_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one ``k`` after the other, from rows in the order of ``k``; null is a value."""
    open_run: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        name = table["k"].combine_chunks()
        if open_run:
            name = pa.concat_arrays([open_run[-1]["k"].combine_chunks()[-1:], name])
        null = pc.is_null(name)
        other = pc.fill_null(pc.not_equal(name[1:], name[:-1]), False)
        other = pc.or_(other, pc.xor(null[1:], null[:-1])).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(other) + (0 if open_run else 1)
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(table)], strict=True):
            if start and open_run:
                yield pa.concat_tables(open_run)
                open_run = []
            elif start == 0 and stop == 0:
                yield pa.concat_tables(open_run)
                open_run = []
            if stop > start:
                open_run.append(table.slice(start, stop - start))
    if open_run:
        yield pa.concat_tables(open_run)


def unsure_grains(lows: np.ndarray, highs: np.ndarray, opened: int | None, span: int) -> np.ndarray:
    """Which grains may hold a window's opening that is not surely the grain's first event.

    ``lows`` and ``highs`` are the first and last event of a key's grains in order. The next window opens with the first
    event from the end of the last one on; two chains, one of earliest and one of latest possible openings, bound it.
    """
    n, never = len(lows), np.iinfo(np.int64).max // 2
    if (lows == highs).all():
        return np.zeros(n, dtype=bool)
    edge = np.zeros(n + 1, dtype=np.int64)
    early = late = int(lows[0]) if opened is None else opened + span
    while (a := int(np.searchsorted(highs, early))) < n:
        b = int(np.searchsorted(highs, late))
        edge[a] += 1
        edge[min(b, n - 1) + 1] -= 1
        early = max(int(lows[a]), early) + span
        late = never if b == n else (int(lows[b]) if lows[b] >= late else int(highs[b])) + span
    return (np.cumsum(edge[:n]) > 0) & (lows < highs)


def window_starts(times: np.ndarray, opened: int | None, span: int) -> list[int]:
    """Openings of a key's windows, from its event times in order; an open window from before is the first."""
    found = [int(times[0]) if opened is None else opened]
    while (i := int(np.searchsorted(times, found[-1] + span))) < len(times):
        found.append(int(times[i]))
    return found


def _window_cells(openers: DataFrame, span: int) -> DataFrame:
    """Windows by the cells (stretches of a window's length) they reach: at most one opens in a cell, one comes from the cell before."""
    cell = _floor_div("opener", span).cast("long")
    own, after = F.struct(cell.alias("cell"), F.lit(True).alias("opens")), F.struct((cell + 1).alias("cell"), F.lit(False).alias("opens"))
    reached = openers.select("k", "opener", F.explode(F.array(own, after)).alias("at")).select("k", "opener", "at.*")
    opens = F.col("opens")
    return reached.groupBy("k", "cell").agg(
        F.max(F.when(opens, F.col("opener"))).alias("own"), F.max(F.when(~opens, F.col("opener"))).alias("before"))
