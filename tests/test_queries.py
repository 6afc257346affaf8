"""Every registered query runs on the smallest tables; some are compared in full."""

from __future__ import annotations

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"

spec = importlib.util.spec_from_file_location("check", Path(__file__).parents[1] / "tools" / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET enable_progress_bar = false; SET TimeZone = 'UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_twin_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, con, name):
    note = check.compare(spark, con, SMALL, QUERIES[name], ORACLES[name])
    assert note.startswith("ok"), note
    assert "types" not in note, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
