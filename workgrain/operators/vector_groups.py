"""Exact nearest vectors from a few files: vectors stored in groups, groups pruned by the angle they span."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_similarity
from .search import knn

SLACK = 1e-9


class VectorGroups:
    """Rows with a vector, stored below ``root`` by the nearest of some centres.

    The centres are vectors of the table itself, chosen by a hash of their id: ``groups`` of them, a stated bound. A group's
    radius is the largest angle between a member and its centre. A vector at angle a from a centre has no member of its group nearer
    than a less the radius, so groups are read in the order of that bound until no other group can hold a better row.
    Rows whose vector is null, zero or of another size have no similarity, are never found, and are not stored.
    """

    def __init__(self, spark: SparkSession, root: str, vector: str = "embedding", ident: str = "id"):
        self.spark, self.root, self.vector, self.ident = spark, root, vector, ident

    def build(self, rows: DataFrame, dimensions: int, groups: int = 64, per_file: int = 1_000_000) -> None:
        """Writes the groups, then their centres and radii."""
        usable = rows.filter((F.size(self.vector) == dimensions) & F.exists(self.vector, lambda x: x != 0))
        first = usable.orderBy(F.xxhash64(self.ident)).select(self.vector).limit(groups).collect()
        centres = _unit(np.array([r[0] for r in first], dtype=np.float64).reshape(-1, dimensions))

        @F.arrow_udf("struct<_group:int,_cosine:double>")
        def nearest(batch: pa.Array) -> pa.Array:
            flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cosine = _unit(flat.reshape(-1, dimensions)) @ centres.T
            best = cosine.argmax(axis=1) if len(cosine) else np.zeros(0, dtype=np.int64)
            return pa.StructArray.from_arrays(
                [pa.array(best.astype(np.int32)), pa.array(cosine[np.arange(len(best)), best])], ["_group", "_cosine"])

        placed = usable.withColumn("_near", nearest(self.vector)).select("*", "_near.*").drop("_near")
        # Large groups are salted by the row, so that no task writes a whole one.
        salted = placed.repartition("_group", F.pmod(F.xxhash64(self.ident), F.lit(16)))
        salted.write.partitionBy("_group").option("maxRecordsPerFile", per_file).parquet(f"{self.root}/rows")
        told = self._rows().groupBy("_group").agg(F.min("_cosine").alias("least")).collect()
        about = [(r["_group"], float(r["least"]), centres[r["_group"]].tolist()) for r in told]
        self.spark.createDataFrame(about, "_group int, least double, centre array<double>").coalesce(1).write.parquet(f"{self.root}/groups")

    def nearest(self, query: Sequence[float], k: int, offset: int = 0) -> tuple[DataFrame, int]:
        """(the rows that ``search.knn`` gives over all rows, number of groups read).

        The driver holds a centre and a bound for each group and one similarity for each round of reading.
        """
        groups = self.spark.read.parquet(f"{self.root}/groups").collect()
        if not groups:
            return self._rows().drop("_group", "_cosine").withColumn("similarity", F.lit(0.0)).limit(0), 0
        q = np.asarray(query, dtype=np.float64)
        angle = np.arccos(np.clip(np.array([r["centre"] for r in groups]) @ (q / np.linalg.norm(q)), -1, 1))
        radius = np.arccos(np.clip([r["least"] for r in groups], -1, 1))
        most = np.cos(np.maximum(0, angle - radius)) + SLACK
        order, read, wave, floor = np.argsort(-most, kind="stable"), 0, 1, -np.inf
        while read < len(order) and most[order[read]] >= floor:
            read, wave = min(len(order), read + wave), wave * 2
            names = [int(groups[i]["_group"]) for i in order[:read]]
            seen = self._rows().filter(F.col("_group").isin(names)).select(
                cosine_similarity(F.col(self.vector), query).alias("s")).orderBy(F.desc("s")).limit(k + offset)
            last = seen.agg(F.min("s"), F.count("*")).first()
            floor = last[0] if last[1] == k + offset else -np.inf
        chosen = self._rows().filter(F.col("_group").isin([int(groups[i]["_group"]) for i in order[:read]]))
        return knn(chosen.drop("_group", "_cosine"), query, k, offset, self.vector, self.ident), read

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
