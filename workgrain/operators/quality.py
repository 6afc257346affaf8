"""Data-quality checks: one report row per check, and a gate that stops a run."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

SAMPLES = 5


@dataclass(frozen=True)
class Check:
    """``kind`` is row_count, not_null, unique, regex or accepted."""

    kind: str
    column: str = ""
    low: int = 0
    high: int = 0
    pattern: str = ""
    values: Sequence[str] = field(default_factory=tuple)

    def failing(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "regex":
            return c.isNotNull() & ~c.rlike(self.pattern)
        if self.kind == "accepted":
            return c.isNotNull() & ~c.isin(*self.values)
        raise ValueError(f"{self.kind} is not a row check")


# The checks of each source before staging and of the silver and gold layers.
ITVIEC_CHECKS = (
    Check("row_count", low=1, high=500),
    Check("not_null", "url"), Check("unique", "url"), Check("not_null", "descriptions"),
    Check("not_null", "requirements"), Check("regex", "url", pattern="^https://"),
)
TOPCV_CHECKS = (
    Check("row_count", low=1, high=500),
    Check("not_null", "url"), Check("unique", "url"), Check("not_null", "descriptions"),
    Check("not_null", "requirements"), Check("not_null", "experience"),
    Check("regex", "url", pattern="^https?://"),
)
BRONZE_CHECKS = (
    Check("not_null", "url"), Check("unique", "url"), Check("not_null", "company"),
    Check("not_null", "descriptions"), Check("not_null", "created_at"),
)
FACT_CHECKS = (
    *[
        Check("not_null", c)
        for c in ("job_id", "source_platform", "url", "job_title", "company_name", "job_posted_date")
    ],
    Check("accepted", "work_model_normalized", values=("Remote", "Hybrid", "On-Site")),
    Check(
        "accepted", "work_arrangement_normalized", values=("Full-time", "Part-time", "Internship")
    ),
)


def _sorting(rows: DataFrame, column: str) -> tuple[Column, Column]:
    """(number, text) by which a column's values sort: numbers by the first, all others by the second."""
    value = F.col(column)
    numeric = isinstance(rows.schema[column].dataType, NumericType)
    return (value.cast("double") if numeric else F.lit(None).cast("double")), value.cast("string")


def report(rows: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: kind, column, failing rows and a few failing values.

    One pass reads the rows. Each gives a key (check, value) where it fails a check, where its value has to be
    unique, or where rows are counted; keys are counted per task before they are shuffled. Of the counted keys each task
    keeps the number of failing rows and the few smallest values of each check, so what meets at the end is small.
    """
    nothing = (F.lit(None).cast("double"), F.lit(None).cast("string"))
    keys = []
    for number, check in enumerate(checks):
        if check.kind == "row_count":
            when, (n, t) = F.lit(True), nothing
        else:
            when = F.col(check.column).isNotNull() if check.kind == "unique" else check.failing()
            n, t = nothing if check.kind == "not_null" else _sorting(rows, check.column)
        keys.append(F.when(when, F.struct(F.lit(number).alias("number"), n.alias("n"), t.alias("t"))))
    found = rows.select(F.explode(F.array_compact(F.array(*keys))).alias("key")).select("key.*")
    counted = found.groupBy("number", "n", "t").agg(F.count("*").alias("times"))
    unique = {number for number, check in enumerate(checks) if check.kind == "unique"}
    sampled = {number for number, check in enumerate(checks) if check.kind not in ("row_count", "not_null")}

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failures, few = Counter(), defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                number = row["number"]
                if number in unique and row["times"] < 2:
                    continue
                failures[number] += row["times"]
                if number in sampled:
                    few[number].append((row["n"] or 0.0, row["t"]))
                    if len(few[number]) > 64:
                        few[number] = nsmallest(SAMPLES, few[number])
        numbers = sorted(failures)
        kept = [[{"n": n, "t": t} for n, t in nsmallest(SAMPLES, few[number])] for number in numbers]
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int32()), pa.array([failures[n] for n in numbers], pa.int64()),
             pa.array(kept, pa.list_(pa.struct([("n", pa.float64()), ("t", pa.string())])))], ["number", "failures", "few"])

    parts = counted.mapInArrow(smallest, "number int, failures long, few array<struct<n:double,t:string>>")
    none = rows.sparkSession.range(len(checks)).select(
        F.col("id").cast("int").alias("number"), F.lit(0).cast("long").alias("failures"),
        F.array().cast("array<struct<n:double,t:string>>").alias("few"))
    merged = parts.unionByName(none).groupBy("number").agg(
        F.sum("failures").alias("failures"), F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, SAMPLES).alias("few"))

    def told(values: Sequence, of: str) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast(of) for v in values]), F.col("number") + 1)

    low, high = told([c.low for c in checks], "long"), told([c.high for c in checks], "long")
    inside = (told([c.kind for c in checks], "string") == "row_count") & F.col("failures").between(low, high)
    return merged.select(
        told([c.kind for c in checks], "string").alias("kind"), told([c.column for c in checks], "string").alias("column"),
        F.when(inside, F.lit(0)).otherwise(F.col("failures")).cast("long").alias("failures"),
        F.array_join(F.array_sort(F.transform("few", lambda v: v["t"])), ", ").alias("samples"))


class CheckFailed(ValueError):
    """Raised by the gate with every failing check."""


def require(rows: DataFrame, checks: Sequence[Check], name: str) -> DataFrame:
    """Returns the rows when all checks pass, else raises with the failing ones."""
    failed = report(rows, checks).filter("failures > 0").collect()
    if failed:
        listed = "; ".join(
            f"{r['kind']}({r['column']}): {r['failures']} [{r['samples']}]" for r in failed
        )
        raise CheckFailed(f"{name}: {listed}")
    return rows
