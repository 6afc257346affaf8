"""Table scans by name, the canonical scan and materialisation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state
from ..schemas import POSTING_COLUMNS
from ..session import scratch_dir
from .keyed import KeyedTable

# A catalog is a folder of parquet tables or a set of JDBC options.
Catalog = str | dict[str, str]


def scan(spark: SparkSession, catalogs: dict[str, Catalog], name: str) -> DataFrame:
    """Table ``catalog.schema.table``, read from the place its catalog names.

    A JDBC catalog with ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions`` reads in parallel; without them Spark reads one partition.
    """
    catalog, schema, table = name.split(".")
    place = catalogs[catalog]
    if isinstance(place, str):
        return spark.read.parquet(f"{place}/{schema}/{table}")
    return spark.read.format("jdbc").options(**place, dbtable=f"{schema}.{table}").load()


def scan_jobs(raw_jobs: DataFrame) -> DataFrame:
    """Staging projection of the canonical table."""
    return raw_jobs.select(
        "id", "title", "company", "location",
        F.col("salary").alias("raw_salary"),
        F.col("experience").alias("raw_experience"),
        "source", "crawled_at",
    )


def as_raw_jobs(rows: DataFrame) -> DataFrame:
    """Canonical column order; a missing vector column becomes null."""
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    return rows.select(*POSTING_COLUMNS)


def materialize(
    rows: DataFrame, name: str, mode: str = "table", path: str | None = None,
    key: Sequence[str] = (), order: Sequence[str] | None = None,
) -> DataFrame:
    """``view`` names a plan, ``table`` writes it out in full and reads it back.

    ``incremental`` keeps a keyed table at ``path``: the first call writes the rows, each later one
    merges its rows into it by ``key`` (a repeated key counts by ``order``); without a key the rows are added.
    What is written follows the rows given, not what is stored.
    """
    if mode == "view":
        rows.createOrReplaceTempView(name)
        return rows
    if mode == "incremental":
        if path is None:
            raise ValueError("an incremental table needs a path")
        if not key:
            rows.write.mode("append").parquet(path)
            return rows.sparkSession.read.schema(rows.schema).parquet(path)

        def change(held: DataFrame | None, batch: DataFrame) -> DataFrame:
            if held is None:
                return state.one_per_key(batch, key, order)
            taken = {c: lambda old, new: new for c in held.columns if c not in key}
            return state.merge(held, batch, key, taken, order)

        stored = KeyedTable(rows.sparkSession, path, key)
        stored.apply(rows, change)
        return stored.read()
    if mode != "table":
        raise ValueError(f"unknown materialisation {mode!r}")
    if path is None:
        rows.write.mode("overwrite").saveAsTable(name)
        return rows.sparkSession.table(name)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fingerprint(spark: SparkSession, paths: Sequence[str]) -> str:
    """Names, sizes and times of the files below some paths, as one hash; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    about = F.concat_ws("|", "path", F.col("modificationTime").cast("string"), F.col("length").cast("string"))
    total = files.agg(F.sum(F.xxhash64(about).cast("decimal(38,0)")), F.count("*")).first()
    return hashlib.md5(f"{total[0]} {total[1]} {sorted(paths)}".encode()).hexdigest()


def layer(spark: SparkSession, name: str, paths: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from files, built once for as long as these files stay the same.

    Its catalog name holds the fingerprint of the files; it is entered when the table is complete. Queries that
    share a layer read one build; changed files give another name. A layer whose files are gone is built again.
    """
    known = f"layer_{name}_{fingerprint(spark, paths)}"
    if spark.catalog.tableExists(known):
        try:
            stored = spark.table(known)
            if stored.inputFiles():
                return stored
        except (AnalysisException, Py4JJavaError):
            pass
        spark.sql(f"DROP TABLE IF EXISTS {known}")
    path = scratch_dir(spark, name)
    rows = build()
    rows.write.parquet(path)
    stored = spark.read.schema(rows.schema).parquet(path)
    try:
        spark.sql(f"CREATE TABLE {known} ({', '.join(f'`{c.name}` {c.dataType.simpleString()}' for c in rows.schema)}) USING parquet LOCATION '{path}'")
    except AnalysisException as taken:  # built by another thread in the meantime
        if taken.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
            raise
    return stored
