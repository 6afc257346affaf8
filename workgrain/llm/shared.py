"""Helpers used by several operators: samples, stored steps and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir


def id_remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo a divisor; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % divisor


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a step to the shared scratch folder and read it back: lost executors repeat only their own part."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Empty the folder of a stored step that nothing reads any more."""
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        df.sparkSession.createDataFrame([], "nothing string").write.mode("overwrite").text(folder)


def class_sample(rows: DataFrame, class_col: str, key_col: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each class, chosen by a hash of the key, so the same rows every time.

    Classes are expected to be few (languages, labels): one count per class goes to the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(class_col).count().collect()}
    share = F.lit(None).cast("double")
    for value, n in counts.items():
        share = F.when(F.col(class_col) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(key_col), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return rows.where(draw < share)


def slices(text: str, size: int, overlap: int = 0) -> Iterator[str]:
    """Consecutive slices of a text, each starting ``overlap`` characters before the last one ended."""
    start = 0
    while True:
        yield text[start : start + size]
        if start + size >= len(text):
            return
        start += size - overlap


def sketch(hashes: DataFrame, bits: int = 26) -> np.ndarray:
    """A bitmap of 2^bits places with a bit for each hash (the only column): which hashes may be among these.

    Its size is fixed (8 MB by default) however many hashes there are; it is put together in Spark, and the
    driver gets at most one word for each 64 places. The more hashes, the more others pass as well, so what
    passes is still to be joined exactly: it only keeps rows that cannot match out of a shuffle.
    """
    place = F.pmod(F.col(hashes.columns[0]), F.lit(1 << bits))
    bit = F.expr("shiftleft(1L, CAST(place & 63 AS INT))")
    words = hashes.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("set"))
    got = words.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy()
    return out


def may_be_in(hashed: Column, bitmap: np.ndarray) -> Column:
    """False only for hashes that are surely not in a sketch."""

    @F.arrow_udf("boolean")
    def test(values: pa.Array) -> pa.Array:
        place = values.to_numpy() & (len(bitmap) * 64 - 1)
        return pa.array((bitmap[place >> 6] >> (place & 63)) & 1 == 1)

    return test(hashed)


def components(links: DataFrame, label: str = "components", checked_every: int = 1) -> DataFrame:
    """Smallest node reachable from each node of an undirected link table (a, b): columns node, component.

    Every round gives each node the smallest label among its own and its neighbours', then follows
    labels one step further (the label of the label), so chains shorten by about half a round. Each
    round is pre-aggregated and stored in the shared folder; only a count of changes reaches the driver.
    """
    both = stored(
        links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where("a <> b").distinct(), label)
    state = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("component")), label)
    while True:
        known = state.select(F.col("node").alias("b"), F.col("component").alias("near"))
        heard = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        nearer = state.join(heard, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("at"))
        further = state.select(F.col("node").alias("at"), F.col("component").alias("there"))
        moved = stored(
            nearer.join(further, "at", "left")
            .select("node", "old", F.least("at", F.coalesce("there", "at")).alias("component")), label)
        changed = moved.where("old <> component").limit(1).count()
        state = moved.select("node", "component")
        if not changed:
            return state
