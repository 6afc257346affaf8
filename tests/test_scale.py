"""What the plans and files look like, and operators that split work beside their plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from workgrain.functions.html import Selectors, _compiled, _matches, tree
from workgrain.operators import digest, quality, ranking
from workgrain.operators import warehouse as wh
from workgrain.operators.matching import join_patterns
from workgrain.operators.search import knn
from workgrain.operators.vector_groups import VectorGroups
from workgrain.plans import fixtures
from workgrain.plans import warehouse as plans
from workgrain.plans.state import alerts, as_of
from workgrain.sources import seeds, tables
from workgrain.streaming import jobs as streams

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_the_fact_reads_each_table_once(spark):
    plan = plan_of(plans.fact(spark, SMALL))
    assert plan.count("FileScan") <= 3
    assert "SortMergeJoin" not in plan or plan.count("Exchange") < 8


def test_layers_are_shared_until_their_files_change(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(5)

    source = f"{tmp_path}/in"
    spark.range(3).write.parquet(source)
    for _ in range(3):
        assert tables.layer(spark, "five", [source], build).count() == 5
    assert len(built) == 1
    spark.range(4).write.mode("append").parquet(source)
    assert tables.layer(spark, "five", [source], build).count() == 5 and len(built) == 2


def test_quantiles_equal_the_percentile(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 5 < 3, "hot").when(F.col("id") % 5 == 3, "few").alias("g"),
        F.when(F.col("id") % 11 != 0, (F.col("id") * 7919 % 997) / 4).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("one", 3.0), ("none", None)], "g string, v double"))
    points = {"q1": 0.25, "mid": 0.5, "q9": 0.9}
    got = ranking.quantiles(rows, ["g"], "v", points)
    want = rows.filter("v IS NOT NULL").groupBy("g").agg(*[F.percentile("v", p).alias(n) for n, p in points.items()])
    assert rows_of(got) == rows_of(want)
    assert ranking.quantiles(rows.limit(0), ["g"], "v", points).count() == 0


def test_running_totals_over_one_value(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), "id", (F.col("id") % 4).alias("n"))
    got = [r["before"] for r in ranking.running_total(rows, [F.col("k"), F.col("id")], "n", "before").orderBy("id").collect()]
    assert got == np.cumsum([0] + [i % 4 for i in range(2999)]).tolist()


def test_patterns_meet_only_texts_that_could_match(spark):
    texts = spark.createDataFrame([("hà nội và huế",), ("Ha Noi",), ("city 7431 of many",), ("x",), (None,), ("no place",)], "place string")
    table = [(f"city {i} |town {i} " if i % 2 else f"place {i}", f"c{i}") for i in range(10_000)]
    table += [("hà nội|ha noi", "hn"), ("(?i)HA NOI", "hn2"), ("x", "short"), ("huế", "hue"), ("huế", "hue")]
    small = spark.createDataFrame(table, "pattern string, name string")
    got = join_patterns(texts, "place", small, "pattern")
    want = texts.join(small, F.expr("place rlike pattern"), "left").select("place", "pattern", "name")
    assert rows_of(got.select("place", "pattern", "name")) == rows_of(want)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    odd = small.union(spark.createDataFrame([("^no .*e$", "regex")], small.schema))
    assert rows_of(join_patterns(texts, "place", odd, "pattern").filter("name = 'regex'").select("place")) == [("no place",)]
    assert join_patterns(texts, "place", small.limit(0), "pattern").count() == 6


def test_large_seed_tables_are_joined(spark):
    rows = spark.createDataFrame([("data engineer", "hà nội"), ("cook", "nowhere")], "title string, working_location string")
    categories = spark.createDataFrame([(f"(?i)job{i}", f"c{i}") for i in range(20)] + [("(?i)engineer|kỹ sư", "Engineering")], seeds.SCHEMAS["job_category_mapping"])
    taken = seeds.seed_patterns(categories, most=10)
    assert not isinstance(taken, list)
    assert rows_of(wh.categorize(rows, taken).select("title", "job_category")) == [("cook", "Others"), ("data engineer", "Engineering")]
    assert isinstance(seeds.seed_patterns(categories), list)


def test_postings_are_offered_under_few_keys(spark):
    ready = digest.sendable(digest.due(alerts(spark, SMALL), as_of()), as_of())
    jobs = fixtures.jobs_raw(spark, SMALL).select(F.col("id").alias("job_id"), "title", "company", "location", "salary")
    filters = ready.withColumn("filter", F.to_json(F.struct("wanted.*"))).select("filter", "wanted").dropDuplicates(["filter"])
    keyed = digest.rarest_keys(filters, jobs)
    offered = digest.offered(jobs, keyed.select("key").distinct())
    assert offered.count() < 3 * jobs.count()


def test_oldest_matches_after_each_cutoff(spark):
    found = spark.range(3000).select(
        F.concat(F.lit("f"), F.col("id") % 3).alias("filter"), F.concat(F.lit("j"), "id").alias("job_id"),
        (F.lit("2001-01-01").cast("timestamp_ntz") + F.make_interval(mins=(F.col("id") * F.col("id") % 9973).cast("int"))).alias("job_at"))
    cutoffs = spark.range(40).select(
        F.concat(F.lit("f"), F.col("id") % 4).alias("filter"),
        (F.lit("2001-01-01").cast("timestamp_ntz") + F.make_interval(mins=(F.col("id") * 251).cast("int"))).alias("cutoff"))
    got = digest.oldest_after(found, cutoffs, 10).select("filter", "cutoff", "job_id", "place")
    pairs = found.join(cutoffs, "filter").filter("job_at > cutoff")
    want = pairs.selectExpr("filter", "cutoff", "job_id", "row_number() OVER (PARTITION BY filter, cutoff ORDER BY job_at, job_id) AS place").filter("place <= 10")
    assert rows_of(got) == rows_of(want)


def test_one_walk_finds_what_each_selector_finds():
    page = tree("<div class='a b'><p id=x>1</p><ul><li class=b>2<li>3</ul></div><p class=b data-k='vv'>4</p><img class=b><p>5</div>")
    selectors = ["p", ".b", "div .b", "#x", "p.b", "[data-k]", "p[data-k^='v']", "ul li, img", "div p", "*[class]"]
    found = Selectors(selectors).find(page)

    def walk(node):
        for part in node.parts:
            if not isinstance(part, str):
                yield part
                yield from walk(part)

    for selector in selectors:
        plain = [n for n in walk(page) if any(_matches(n, chain) for chain in _compiled(selector))]
        assert found.below(page, selector) == plain
        for root in walk(page):
            assert found.below(root, selector) == [n for n in walk(root) if n in plain]
            assert found.first(root, selector) is next((n for n in walk(root) if n in plain), None)


@pytest.mark.parametrize("page,text", [
    ("a<!-- <b>no</b> -->b", "a b"), ("<p>x &amp; y<script>var t='</p>';</script> z", "x & y z"), ("1 < 2 <b>c</b>", "1 < 2 c"),
    ("<P CLASS=Up>t</P>", "t"), ("<title>a <b> c</title>d", "a <b> c d"), ("</p>e<br/>f", "e f"), ("<a href='>'>g</a>", "g"),
])
def test_page_trees(page, text):
    assert tree(page).text() == text


def test_checks_read_their_rows_once(spark):
    rows = fixtures.jobs_raw(spark, SMALL).withColumnRenamed("description", "descriptions")
    plan = plan_of(quality.report(rows, quality.TOPCV_CHECKS))
    assert plan.count("FileScan") == 2  # orders and customers, which the view joins
    assert plan.count("MapInArrow") == 1


def test_searches_skip_groups(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((20, 16))
    data = [(i, [float(x) for x in centres[i % 20] * 5 + rng.standard_normal(16) * 0.3]) for i in range(1500)]
    data += [(5000, None), (5001, [0.0] * 16), (5002, [1.0] * 3)]
    rows = spark.createDataFrame(data, "id long, embedding array<float>")
    stored = VectorGroups(spark, f"{tmp_path}/groups")
    stored.build(rows, 16, groups=40)
    total = spark.read.parquet(f"{tmp_path}/groups/groups").count()
    for query, k, offset in ((data[3][1], 5, 0), (data[8][1], 10, 20), ([1.0] * 16, 7, 3), (data[0][1], 1498, 0)):
        got, read = stored.nearest(query, k, offset)
        want = knn(rows, query, k, offset)
        assert [r["id"] for r in got.collect()] == [r["id"] for r in want.collect()]
        if k == 5:
            assert read < total / 2


def test_deliveries_read_the_days_of_the_batch(spark, tmp_path):
    sink = streams.deliver_once(f"{tmp_path}/out", ["hour", "user_id"], ["event_id"])
    layout = "hour timestamp_ntz, user_id long, event_id long"

    def batch(day, ids):
        return spark.range(len(ids)).select(
            (F.lit(f"2001-01-{day:02d}").cast("timestamp_ntz")).alias("hour"), F.lit(7).cast("long").alias("user_id"),
            F.element_at(F.array(*map(F.lit, ids)), (F.col("id") + 1).cast("int")).cast("long").alias("event_id"))

    for number, (day, ids) in enumerate([(1, [5, 4]), (2, [6]), (1, [1]), (2, [9]), (3, [8])]):
        sink(batch(day, ids), number)
        sink(batch(day, ids), number)
    kept = streams.delivered(spark, f"{tmp_path}/out", spark.createDataFrame([], layout).schema)
    assert sorted((r["day"].day, r["event_id"]) for r in kept.collect()) == [(1, 4), (2, 6), (3, 8)]
    pruned = kept.filter(F.col("day").between(F.lit("2001-01-02").cast("date"), F.lit("2001-01-02").cast("date")))
    plan = plan_of(pruned)
    assert "PartitionFilters: [isnotnull(day" in plan
