"""Archive of crawled pages: one folder per source, kind and crawl date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import last_segment

PARTITIONS = ("source", "kind", "crawl_date")


def scan_page_files(spark: SparkSession, root: str) -> DataFrame:
    """Loose ``*.html`` files below ``root/source=…/kind=…/crawl_date=…``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.html")
        .option("recursiveFileLookup", "false")
        .load(root)
    )
    return files.select(
        last_segment(F.col("path")).alias("page_id"),
        F.decode("content", "UTF-8").alias("html"),
        *PARTITIONS,
    )


def write_pages(pages: DataFrame, root: str, mode: str = "append") -> None:
    """Packs pages into partitioned files; one shuffle keeps the file count low.

    A third of the pages may share one partition, so rows spread over salts
    within a partition rather than over the partition columns alone.
    """
    salted = pages.repartition(*PARTITIONS, F.pmod(F.xxhash64("page_id"), F.lit(64)))
    salted.write.mode(mode).partitionBy(*PARTITIONS).parquet(root)


def scan_pages(
    spark: SparkSession, root: str, source: str | None = None,
    kind: str | None = None, crawl_date: str | None = None,
) -> DataFrame:
    """Packed archive; the arguments prune partitions."""
    pages = spark.read.parquet(root)
    for name, value in zip(PARTITIONS, (source, kind, crawl_date)):
        if value is not None:
            pages = pages.filter(F.col(name) == value)
    return pages
