"""Group measures kept up to date by deltas, so that a batch of changed postings costs what it holds.

Three keyed tables hold a mart: per url what its rows add to which groups, per group the additive totals, and per
(group, column, value) how many rows have the value. A batch brings all rows of its urls. What these urls added before
is taken off, what they add now is put on; distinct counts, extremes and sets follow from the values that still have rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.keyed import KeyedTable
from . import measures

EXTREMES = {"salary_min_million": "salary_low", "salary_max_million": "salary_high", "job_posted_date": "date"}


class Mart:
    """Measures of ``measures.grouped`` by ``keys``, over all batches applied so far."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], flags: Sequence[str] = (),
                 distinct: Sequence[str] = (), sets: Sequence[str] = (), buckets: int = 16):
        self.spark, self.keys, self.flags, self.distinct, self.sets = spark, list(keys), list(flags), list(distinct), list(sets)
        self._urls = KeyedTable(spark, f"{root}/urls", ["url"], buckets)
        self._totals = KeyedTable(spark, f"{root}/totals", ["group_key"], buckets)
        self._values = KeyedTable(spark, f"{root}/values", ["group_key", "column", "value"], buckets)

    def update(self, rows: DataFrame, removed: DataFrame | None = None, number: int = 0) -> None:
        """Applies a batch: all current rows of the urls it holds; ``removed`` lists urls that have none any more.

        Rows without a url have no earlier state and are added. A batch is applied once: one that was broken off goes on where
        it ended, and one whose number has been applied does nothing. Numbers rise.
        """
        if self._urls.version() is not None and self._urls.note() >= number:
            return
        new = self._kept(self._parts(rows, removed))
        old = new.select(F.col("url").alias("url")).limit(0)
        if self._urls.version() is not None:
            before = self._urls.read().join(new.select("url").filter("url IS NOT NULL").distinct(), "url", "left_semi")
            old = before.select(F.explode("parts").alias("p"), F.lit(-1).alias("sign"))
        added = new.select(F.explode("parts").alias("p"), F.lit(1).alias("sign"))
        both = added if self._urls.version() is None else added.unionByName(old)
        delta = self._kept(both)
        amounts = ["rows", "salary_sum", "salary_rows", *[f"n_{f}" for f in self.flags]]
        totals = delta.groupBy(F.col("p.group_key").alias("group_key")).agg(
            *[F.first(F.col(f"p.{k}")).alias(k) for k in self.keys], *[F.sum(F.col(f"p.{a}") * F.col("sign")).alias(a) for a in amounts])
        values = delta.select(F.col("p.group_key").alias("group_key"), F.explode("p.seen").alias("s"), "sign").groupBy(
            "group_key", F.col("s.column").alias("column"), F.col("s.value").alias("value")).agg(F.sum(F.col("s.times") * F.col("sign")).alias("times"))
        self._add(self._totals, totals, amounts, number)
        self._add(self._values, values, ["times"], number)
        self._urls.apply(new, lambda held, batch: batch, note=number)

    def read(self) -> DataFrame:
        """One row per group: the columns that ``measures.grouped`` gives, without groups that have no row left."""
        groups = self._totals.read().filter("rows > 0")
        there = self._values.read().filter("times > 0")

        def of(column: str) -> Column:
            return F.when(F.col("column") == column, F.col("value"))

        number, day = (lambda c: of(c).cast("long")), (lambda c: of(c).cast("date"))
        told = there.groupBy("group_key").agg(
            F.min(number("salary_min_million")).alias("salary_low"), F.max(number("salary_max_million")).alias("salary_high"),
            F.min(day("job_posted_date")).alias("first_date"), F.max(day("job_posted_date")).alias("last_date"),
            *[F.count(of(c)).alias(f"d_{c}") for c in self.distinct],
            *[F.array_sort(F.collect_list(of(c))).alias(f"s_{c}") for c in self.sets])
        joined = groups.join(told, "group_key", "left")
        return joined.withColumn("avg_salary", F.round(F.col("salary_sum") / F.nullif("salary_rows", F.lit(0)), 1)).drop(
            "group_key", "salary_sum", "salary_rows")

    def _parts(self, rows: DataFrame, removed: DataFrame | None) -> DataFrame:
        """url, parts: what each url's rows add to each group, with the values they have; no parts for a removed url."""
        tests = measures.url_flags()
        watched = list(dict.fromkeys([*self.distinct, *self.sets, *EXTREMES]))
        seen = F.array(*[
            F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))) for c in watched])
        marked = rows.select(
            *self.keys, "url", F.to_json(F.struct(*self.keys), {"ignoreNullFields": "false"}).alias("group_key"), measures.SALARY,
            F.array_compact(seen).alias("_seen"),
            *[(F.coalesce(tests[f], F.lit(False)) & F.col("url").isNotNull()).cast("int").alias(f"n_{f}") for f in self.flags])
        by_value = marked.select("url", "group_key", F.explode("_seen").alias("s")).groupBy("url", "group_key", "s").agg(F.count("*").alias("times"))
        lists = by_value.groupBy("url", "group_key").agg(
            F.collect_list(F.struct(F.col("s.column").alias("column"), F.col("s.value").alias("value"), "times")).alias("seen"))
        sums = marked.groupBy("url", "group_key", *self.keys).agg(
            F.count("*").alias("rows"), F.coalesce(F.sum(measures.SALARY).cast("double"), F.lit(0.0)).alias("salary_sum"),
            F.count(measures.SALARY).alias("salary_rows"), *[F.max(f"n_{f}").cast("long").alias(f"n_{f}") for f in self.flags])
        whole = sums.join(lists, sums["url"].eqNullSafe(lists["url"]) & (sums["group_key"] == lists["group_key"]), "left").drop(
            lists["url"], lists["group_key"])
        empty = F.array().cast("array<struct<column:string,value:string,times:bigint>>")
        part = F.struct("group_key", *self.keys, "rows", "salary_sum", "salary_rows", F.coalesce("seen", empty).alias("seen"),
                        *[f"n_{f}" for f in self.flags])
        parts = whole.groupBy("url").agg(F.collect_list(part).alias("parts"))
        if removed is None:
            return parts
        gone = removed.select("url").distinct().join(parts.select("url"), "url", "left_anti")
        return parts.unionByName(gone.withColumn("parts", F.array().cast(parts.schema["parts"].dataType)))

    def _add(self, table: KeyedTable, delta: DataFrame, amounts: Sequence[str], number: int) -> None:
        if table.version() is not None and table.note() >= number:
            return

        def change(held: DataFrame | None, batch: DataFrame) -> DataFrame:
            if held is None:
                return batch
            return held.unionByName(batch).groupBy(*table.keys).agg(
                *[F.sum(c).alias(c) if c in amounts else F.first(c).alias(c) for c in batch.columns if c not in table.keys])

        table.apply(delta, change, note=number)

    def _kept(self, rows: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark, "mart-batch")
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)
