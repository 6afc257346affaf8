"""A keyed table that grows: rows in buckets by key, and commits whose size follows the batch, not the table."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: (stored rows whose key is in the batch, or None for a new table; batch) → these rows after the batch, and new ones.
Change = Callable[[DataFrame | None, DataFrame], DataFrame]
Parts = dict[int, list[str]]

MANIFEST = "bucket int, place int, folder string, about string"
MARKS = "version long, manifest string"


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class KeyedTable:
    """Parquet files below ``root``, in ``buckets`` buckets by a hash of ``keys``; at most ``parts`` folders a bucket.

    A version is a manifest: the folders of each bucket, oldest first. A commit writes the changed and new rows only, as one
    folder more for each bucket that the batch's keys fall in; a reader takes a key's row from its bucket's newest folder
    that has it. A bucket that has ``parts`` folders is written anew as one. Then the manifest is written, and the
    version's name is created in the session's catalog. The catalog creates a name once only, so of two writers that
    start from one version the second fails; it reads the new version and applies its batch again. Readers see a
    version as a whole or not at all, and files of a version are never written again.

    The catalog must be one that all writers share (a metastore; the in-memory catalog of a single session is enough for
    its threads). Each commit is also marked below ``root``: a session whose catalog does not know the table goes on from the
    last mark. The driver holds the folder names of the buckets, ``buckets * parts`` at most.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64, parts: int = 8):
        self.spark, self.root, self.keys, self.buckets, self.parts = spark, root.rstrip("/"), list(keys), buckets, parts
        self._prefix = f"keyed_{hashlib.md5(self.root.encode()).hexdigest()[:16]}_"

    def versions(self) -> list[int]:
        """Numbers of the versions whose names the catalog has, oldest first."""
        names = [r["tableName"] for r in self.spark.sql(f"SHOW TABLES LIKE '{self._prefix}*'").collect()]
        found = sorted(int(n.removeprefix(self._prefix)) for n in names)
        return found or self._adopt()

    def version(self) -> int | None:
        """Number of the latest version, from 0; None for a table without any."""
        found = self.versions()
        return found[-1] if found else None

    def note(self, version: int | None = None) -> object:
        """What the writer noted with a version."""
        return self._manifest(self.version() if version is None else version)[1]["note"]

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the latest."""
        return self._rows(*self._manifest(self.version() if version is None else version))

    def apply(self, batch: DataFrame, change: Change, note: object = None, attempts: int = 5) -> int:
        """Commits what ``change`` makes of the stored rows with the batch's keys; returns the version.

        ``change`` gives whole rows, of keys in the batch only; a stored row that it leaves out stays as it is. Rows with a
        null key are never looked up: they are added each time. When another writer was first, the batch is applied to what
        that one left.
        """
        landed = f"{self.root}/batches/{uuid.uuid4().hex}"
        batch.write.parquet(landed)  # read several times below
        batch = self.spark.read.schema(batch.schema).parquet(landed)
        touched = [r["bucket"] for r in batch.select(self._bucket().alias("bucket")).distinct().collect()]
        wanted = batch.select(*self.keys).distinct()
        for attempt in range(attempts):
            version, held, about = self.version(), {}, None
            if version is not None:
                held, about = self._manifest(version)
            mine = {b: held[b] for b in touched if b in held}
            rows = change(None if about is None else self._rows(mine, about).join(wanted, self.keys, "left_semi"), batch)
            if about is None:
                about = {"schema": json.loads(rows.schema.json()), "buckets": self.buckets}
            rows = rows.select(*StructType.fromJson(about["schema"]).names)
            full = {b: f for b, f in mine.items() if len(f) >= self.parts}
            if full:
                rows = rows.unionByName(self._rows(full, about).join(wanted, self.keys, "left_anti"))
            folder, there = self._write(rows)
            after = {b: f for b, f in held.items() if b not in full}
            after |= {b: [*after.get(b, []), folder] for b in there}
            try:
                done = self._commit(0 if version is None else version + 1, after, about | {"note": note})
            except Conflict:
                self._empty(folder, there)
                if attempt + 1 == attempts:
                    raise
            else:
                self._clear(landed)
                return done
        raise AssertionError("unreachable")

    def drop_old(self, keep: int = 2) -> int:
        """Empties the folders that none of the last ``keep`` versions has; returns the number of a bucket's folders emptied.

        The names of older versions leave the catalog. A writer or reader that is slower than ``keep`` commits fails.
        """
        found = self.versions()
        old, live = ({(b, f) for v in vs for b, fs in self._manifest(v)[0].items() for f in fs} for vs in (found[:-keep], found[-keep:]))
        dead = defaultdict(list)
        for bucket, folder in old - live:
            dead[folder].append(bucket)
        for folder, buckets in dead.items():
            self._empty(folder, buckets)
        for version in found[:-keep]:
            self.spark.sql(f"DROP TABLE {self._name(version)}")
        return len(old - live)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _name(self, version: int) -> str:
        return f"{self._prefix}{version:012d}"

    def _rows(self, held: Parts, about: dict) -> DataFrame:
        schema = StructType.fromJson(about["schema"])

        def folders(chosen: Iterable[tuple[int, str]]) -> DataFrame:
            paths = [f"{self.root}/data/{f}/_bucket={b}" for b, f in chosen]
            return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

        single = folders((b, f[0]) for b, f in held.items() if len(f) == 1)
        several = {b: f for b, f in held.items() if len(f) > 1}
        if not several:
            return single
        aged: dict[int, list] = defaultdict(list)  # folders of one age are one scan
        for bucket, names in several.items():
            for age, name in enumerate(names):
                aged[age].append((bucket, name))
        stacked = reduce(DataFrame.unionByName, [folders(f).withColumn("_age", F.lit(a)) for a, f in sorted(aged.items())])
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        newest = stacked.filter(known).groupBy(*self.keys).agg(F.max_by(F.struct(*schema.names), "_age").alias("_row")).select("_row.*")
        return single.unionByName(newest).unionByName(stacked.filter(~known).drop("_age"))

    def _manifest(self, version: int) -> tuple[Parts, dict]:
        rows = self.spark.table(self._name(version)).collect()
        about = next(json.loads(r["about"]) for r in rows if r["about"] is not None)
        if about["buckets"] != self.buckets:
            raise ValueError(f"{self.root} has {about['buckets']} buckets, not {self.buckets}")
        held: Parts = defaultdict(list)
        for r in sorted((r for r in rows if r["about"] is None), key=lambda r: r["place"]):
            held[r["bucket"]].append(r["folder"])
        return dict(held), about

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """(folder, buckets that have rows in it); rows of a bucket meet in one task, or a few if they are many."""
        folder = uuid.uuid4().hex
        placed = rows.withColumn("_bucket", self._bucket())
        placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.root}/data/{folder}")
        written = self.spark.read.schema(placed.schema).parquet(f"{self.root}/data/{folder}").select("_bucket").distinct()
        return folder, sorted(r["_bucket"] for r in written.collect())

    def _commit(self, version: int, held: Parts, about: dict) -> int:
        manifest = f"{self.root}/log/{uuid.uuid4().hex}"
        rows = [(b, i, f, None) for b, fs in sorted(held.items()) for i, f in enumerate(fs)] + [(None, None, None, json.dumps(about))]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(manifest)
        self._claim(version, manifest)
        found = self.versions()
        if version in found and version + 1 not in found and found[-1] > version:
            self.spark.sql(f"DROP TABLE {self._name(version)}")  # the name was free because drop_old had taken it away
            raise Conflict(f"version {version} of {self.root} is long gone")
        self.spark.createDataFrame([(version, manifest)], MARKS).coalesce(1).write.mode("append").json(f"{self.root}/marks")
        return version

    def _claim(self, version: int, manifest: str) -> None:
        try:
            self.spark.sql(f"CREATE TABLE {self._name(version)} ({MANIFEST}) USING parquet LOCATION '{manifest}'")
        except AnalysisException as taken:
            if taken.getCondition() != "TABLE_OR_VIEW_ALREADY_EXISTS":
                raise
            raise Conflict(f"version {version} of {self.root} is taken") from taken

    def _adopt(self) -> list[int]:
        """Enters the last marked version in a catalog that has no name of the table."""
        try:
            last = self.spark.read.schema(MARKS).json(f"{self.root}/marks").orderBy(F.desc("version")).first()
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        try:
            self._claim(last["version"], last["manifest"])
        except Conflict:
            pass
        return [last["version"]]

    def _empty(self, folder: str, buckets: Iterable[int]) -> None:
        for bucket in buckets:
            self._clear(f"{self.root}/data/{folder}/_bucket={bucket}")

    def _clear(self, path: str) -> None:
        self.spark.createDataFrame([], "nothing string").write.mode("overwrite").text(path)
