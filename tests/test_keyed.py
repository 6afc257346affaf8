"""The keyed table: what a commit writes, what readers see, and two writers at once."""

from __future__ import annotations

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from workgrain.operators import state
from workgrain.sources import tables
from workgrain.sources.keyed import Conflict, KeyedTable


def replace(held, batch):
    return batch


def rows_of(df):
    return in_order(map(tuple, df.collect()))


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is None, v) for v in row])


def files_of(root):
    return {p: p.stat().st_size for p in Path(root).glob("data/*/*/part-*.parquet")}


def test_a_commit_writes_the_batch_and_not_the_table(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=8)
    table.apply(spark.range(20_000).select("id", F.concat(*(F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(4))).alias("text")), replace)
    first = files_of(tmp_path / "t")
    changed = spark.createDataFrame([(5, "five"), (7, "seven"), (20_000, "new")], "id long, text string")
    table.apply(changed, replace)
    added = {p: n for p, n in files_of(tmp_path / "t").items() if p not in first}
    assert all(p.exists() for p in first) and 1 <= len(added) <= 3
    assert sum(added.values()) < sum(first.values()) / 50
    got = table.read()
    assert got.count() == 20_001
    assert rows_of(got.where("id IN (5, 7, 20000)")) == [(5, "five"), (7, "seven"), (20_000, "new")]
    assert table.read(0).count() == 20_000 and table.read(0).where("id = 5").first()["text"] != "five"


def test_many_commits_equal_a_plain_merge(spark, tmp_path):
    """Changes by the rule of the caller, over more commits than a bucket keeps folders; null keys are added."""
    table, want = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=4, parts=3), {}
    for n in range(8):
        batch = [(i, f"{n}-{i}", n) for i in range(n * 3, n * 3 + 7)] + [(None, f"none {n}", n)]

        def change(held, rows):
            return rows if held is None else state.merge(held, rows, ["id"], {"text": lambda old, new: F.concat(old, F.lit("+"), new)})

        table.apply(spark.createDataFrame(batch, "id long, text string, n int"), change, note={"batch": n})
        for i, text, at in batch:
            key = i if i is not None else f"null {n}"
            want[key] = (i, f"{want[key][1]}+{text}", want[key][2]) if key in want else (i, text, at)
        assert table.note() == {"batch": n}
    assert rows_of(table.read()) == in_order(want.values())
    assert table.versions() == list(range(8))


def test_two_writers_of_one_version(spark, tmp_path):
    """One commit fails, reads what the other left, and is applied to that: nothing is lost."""
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=2)
    table.apply(spark.createDataFrame([(1, 0)], "id long, n int"), replace)
    together, tries = threading.Barrier(2), []

    def add(name):
        def change(held, batch):
            tries.append(name)
            if tries.count(name) == 1:
                together.wait(timeout=60)  # both have read version 0
            return state.merge(held, batch, ["id"], {"n": lambda old, new: old + new})

        KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=2).apply(spark.createDataFrame([(1, 1), (name, 1)], "id long, n int"), change)

    writers = [threading.Thread(target=add, args=(n,)) for n in (10, 20)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(tries).count(10) + tries.count(20) == 3
    assert rows_of(table.read()) == [(1, 2), (10, 1), (20, 1)] and table.versions() == [0, 1, 2]

    def late(held, batch):
        KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=2).apply(spark.createDataFrame([(2, 2)], "id long, n int"), replace)
        return batch

    with pytest.raises(Conflict):
        table.apply(spark.createDataFrame([(3, 3)], "id long, n int"), late, attempts=1)
    assert rows_of(table.read()) == [(1, 2), (2, 2), (10, 1), (20, 1)]


def test_old_versions_go_and_a_new_catalog_finds_the_table(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=2, parts=2)
    for n in range(6):
        table.apply(spark.createDataFrame([(i, n) for i in range(10)], "id long, n int"), replace)
    before = len(files_of(tmp_path / "t"))
    assert table.drop_old(keep=1) > 0
    assert table.versions() == [5] and len(files_of(tmp_path / "t")) < before
    assert rows_of(table.read()) == [(i, 5) for i in range(10)]
    spark.sql(f"DROP TABLE {table._name(5)}")  # as in a session whose catalog never had it
    again = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=2, parts=2)
    assert again.version() == 5 and rows_of(again.read()) == [(i, 5) for i in range(10)]
    assert KeyedTable(spark, f"{tmp_path}/none", ["id"]).version() is None
    with pytest.raises(ValueError, match="buckets"):
        KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=3).read()


def test_empty_batches(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", ["id"], buckets=2)
    none = spark.createDataFrame([], "id long, n int")
    table.apply(none, replace)
    assert table.read().count() == 0
    table.apply(spark.createDataFrame([(1, 1)], "id long, n int"), replace)
    table.apply(none, replace, note="nothing")
    assert rows_of(table.read()) == [(1, 1)] and table.note() == "nothing"


def test_incremental_materialisation(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "id long, text string, seq int")
    tables.materialize(rows, "t", "incremental", f"{tmp_path}/t", ["id"], ["seq"])
    got = tables.materialize(rows.limit(0).union(spark.createDataFrame([(2, "d", 5), (3, "e", 5)], rows.schema)), "t", "incremental", f"{tmp_path}/t", ["id"], ["seq"])
    assert rows_of(got) == [(1, "b", 1), (2, "d", 5), (3, "e", 5)]
    for _ in range(2):
        added = tables.materialize(rows, "t", "incremental", f"{tmp_path}/plain")
    assert added.count() == 6
