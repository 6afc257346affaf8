"""Plans and files of the steps that were reworked for size."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from workgrain.operators import matching, pages, state
from workgrain.plans import streams as plans
from workgrain.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan_of(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_pattern_values_need_no_lambda(spark):
    rows = spark.createDataFrame([("ab",), ("b",), ("",), (None,)], "t string")
    found = matching.explode_patterns(rows, "t", [("a", "A"), ("b", "B"), ("a|b", "A")], "v")
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["t"], r["v"]) for r in found.collect()] == [("ab", "A"), ("ab", "B"), ("ab", "A"), ("b", "B"), ("b", "A"), ("", None), (None, None)]


def test_a_batch_dealt_by_its_keys_is_not_dealt_again(spark):
    batch = spark.createDataFrame([(1, "a", 5), (1, "b", 4), (None, "c", 3), (2, None, 2), (None, "c", 3)], "k int, t string, n int")
    single = state.one_per_key(batch.repartition(7, "k"), ["k"]).filter("k IS NOT NULL")
    assert plan_of(single.groupBy("k").count()).count("Exchange hashpartitioning") <= 2  # one for each part of the union
    by_n = state.one_per_key(batch, ["k"], ["n"], first_of=["t"])
    assert sorted(map(str, state.one_per_key(batch, ["k"]).collect())) == sorted(map(str, [
        r for r in batch.collect() if r["k"] is None or r["t"] != "a"]))
    assert sorted((str(r["k"]), str(r["t"]), r["n"]) for r in by_n.collect()) == [
        ("1", "b", 5), ("2", "None", 2), ("None", "c", 3), ("None", "c", 3)]
    assert "REPARTITION_BY_NUM" in QUERIES["u8_ledger_upsert"](spark, SMALL)._jdf.queryExecution().toString()


def test_a_micro_batch_has_as_many_files_as_its_rows_need(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(plans, "FILE_ROWS", 700)
    monkeypatch.setattr(plans, "scratch_dir", lambda s, label: f"{tmp_path}/{label}")
    got = QUERIES["t2_first_seen_dedup"](spark, SMALL)
    rows = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    files = glob.glob(f"{tmp_path}/lineitem-files/part-*")
    assert len(files) > 4 and max(spark.read.parquet(f).count() for f in files) < 1400
    assert len(glob.glob(f"{tmp_path}/first-seen/urls/batch=*")) == 4
    want = rows.groupBy(F.concat(F.lit("https://jobs.example/"), "l_orderkey").alias("url")).agg(F.min("l_shipdate").alias("first_seen"))
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_markup_is_cleaned_a_few_values_at_a_time(spark):
    rows = spark.createDataFrame([(i, None if i % 50 == 0 else f"<article><p>{i}<script>x</script></p></article>") for i in range(200)], "i int, h string")
    got = pages.sanitize_html(rows.coalesce(1), "h").orderBy("i").collect()
    assert [r["h"] for r in got] == [None if i % 50 == 0 else f"<p>{i}</p>" for i in range(200)]
    assert "ArrowEvalPython" in plan_of(pages.sanitize_html(rows, "h"))
