"""Row numbers, running totals and exact quantiles over a whole table without sending it through one task."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir

PART_SHIFT = 33


def _placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` stored in the given order, with ``_place``: the task in the high bits, the place inside it in the low ones."""
    spread = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns)).asc()
    ordered = rows.repartitionByRange(*order, spread).sortWithinPartitions(*order, spread)
    path = scratch_dir(rows.sparkSession, "ranked")
    placed = ordered.withColumn("_place", F.monotonically_increasing_id())
    placed.write.parquet(path)
    return rows.sparkSession.read.schema(placed.schema).parquet(path)


def _starts(placed: DataFrame, amount: Column) -> Column | None:
    """Sum of ``amount`` over all tasks before the row's own; only one sum per task reaches the driver."""
    part = F.shiftright("_place", PART_SHIFT)
    sums = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).agg(F.sum(amount)).collect())
    if not sums:
        return None
    before = itertools.accumulate((n for _, n in sums), initial=0)
    starts = F.create_map(*(F.lit(v) for (p, _), at in zip(sums, before, strict=False) for v in (p, at)))
    return F.element_at(starts, part)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their number (from 1, long) in the given order over all rows.

    Rows are dealt to tasks by ranges of the order and sorted inside each; a row's place among those of its task
    is the low part of its generated id. The number is the place plus the counts of all tasks before. The sorted rows are
    stored first, so that ranges, counts and places come from one run however often tasks are repeated. Rows that are equal
    in the order are spread by a hash of the whole row; which of them comes first is fixed, whatever the number of
    tasks, unless they are equal in every column.
    """
    placed = _placed(rows, order)
    start = _starts(placed, F.lit(1))
    inside = F.col("_place").bitwiseAND((1 << PART_SHIFT) - 1)
    number = F.lit(0) if start is None else start + inside + 1
    return placed.withColumn(name, number.cast("long")).drop("_place")


def running_total(rows: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` (a whole number) over all rows before them in the given order."""
    placed = _placed(rows, order)
    start = _starts(placed, F.col(amount))
    part = Window.partitionBy(F.shiftright("_place", PART_SHIFT)).orderBy("_place")
    inside = F.coalesce(F.sum(amount).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.lit(0) if start is None else start + inside
    return placed.withColumn(name, total.cast("long")).drop("_place")


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles of a column per group, named as in ``points``; null values do not count.

    Equal values are counted first; a running total over groups and values gives each value the ranks that it
    covers, and the ranks that a quantile lies between are picked from it. No state grows with the values of a group.
    """
    keys = list(keys)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counted, [F.col(k).asc_nulls_first() for k in keys] + [F.col(value).asc()], "_n", "_before")
    sizes = ranked.groupBy(*keys).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_size"))
    same = reduce(lambda a, b: a & b, [ranked[k].eqNullSafe(sizes[k]) for k in keys])
    joined = ranked.join(sizes, same).drop(*[sizes[k] for k in keys])
    at = F.col("_before") - F.col("_first")
    found, cuts = [], []
    for name, point in points.items():
        place = (F.col("_size") - 1) * F.lit(point)
        for end, rank in (("low", F.floor(place)), ("high", F.ceil(place))):
            found.append(F.max(F.when((at <= rank) & (rank < at + F.col("_n")), F.col(value).cast("double"))).alias(f"{name}_{end}"))
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        cuts.append(F.when(low == high, low).otherwise(
            (F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name))
    return joined.groupBy(*keys, "_size").agg(*found).select(*keys, *cuts)
