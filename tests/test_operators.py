from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from workgrain.operators import digest, measures, pages, quality, search, state
from workgrain.operators.matching import explode_patterns, join_patterns
from workgrain.plans import fixtures
from workgrain.plans.state import target_and_batch
from workgrain.sources import pages as archive
from workgrain.sources import seeds, tables

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_pattern_joins_agree(spark):
    texts = spark.createDataFrame([("hà nội hn",), ("hn dn",), ("xa",), (None,)], "t string")
    patterns = [("hà|hn", "A"), ("dn", "B")]
    table = spark.createDataFrame(patterns, "pattern string, v string")
    want = [("hn dn", "A"), ("hn dn", "B"), ("hà nội hn", "A"), ("xa", None), (None, None)]
    key = lambda r: tuple(str(x) for x in r)
    for got in (
        explode_patterns(texts, "t", patterns, "v"),
        join_patterns(texts, "t", table, "pattern").select("t", "v"),
    ):
        assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


def test_upsert_keeps_first_crawl_time_and_fresh_vectors(spark):
    schema = "id string, title string, company string, location string, salary string, experience string, description string, requirements string, tags string, source string, url string, crawled_at timestamp_ntz"
    def row(i, title, day, pay):
        return (i, title, "c", None, pay, None, "d", "r", "", "topcv", f"u{i}", day and datetime(2026, 1, day))

    old = spark.createDataFrame([row("1", "a", 1, "x"), row("2", "b", 1, "x"), row("3", None, None, "x")], schema)
    old = old.withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    new = spark.createDataFrame([row("1", "a", 9, "y"), row("2", "B", 9, "y"), row("3", None, 9, "y"), row("4", "n", 9, "y")], schema)
    merged = {r["id"]: r for r in state.upsert_jobs(old, new).collect()}
    assert len(merged) == 4 and {r["salary"] for r in merged.values()} == {"y"}
    assert merged["1"]["crawled_at"] == datetime(2026, 1, 1) and merged["1"]["embedding"] == [1.0]
    assert merged["2"]["embedding"] is None and merged["4"]["embedding"] is None
    assert merged["3"]["embedding"] == [1.0] and merged["3"]["crawled_at"] == datetime(2026, 1, 9)


def test_upsert_is_idempotent_and_inserts_once(spark):
    target, batch = target_and_batch(spark, SMALL)
    once = state.upsert_jobs(target, batch)
    assert rows_of(once.select("id")) == rows_of(state.upsert_jobs(once, batch).select("id"))
    table, inserted = state.insert_new(target, batch, "id")
    again, none = state.insert_new(table, batch, "id")
    assert none.count() == 0 and again.count() == table.count() == target.count() + inserted.count()


def test_upsert_does_not_shuffle_the_target(spark):
    target, batch = target_and_batch(spark, SMALL)
    stored = tables.materialize(target, "t", path=fixtures_dir(spark))
    small = tables.materialize(batch, "b", path=fixtures_dir(spark))
    plan = state.upsert_jobs(stored, small)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def fixtures_dir(spark):
    from workgrain.session import scratch_dir

    return scratch_dir(spark, "test")


def test_global_rank_equals_row_number(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("n"), F.md5(F.col("id").cast("string")).alias("k"))
    got = [r["k"] for r in measures.global_rank(rows, "n", "k", "rank").orderBy("rank").collect()]
    want = [r["k"] for r in rows.orderBy(F.desc("n"), "k").collect()]
    assert got == want


def test_global_rank_keeps_rows_without_id(spark):
    rows = spark.createDataFrame([(3, "b"), (3, None), (3, "a"), (None, "c"), (5, None)], "n int, k string")
    got = measures.global_rank(rows, "n", "k", "rank").orderBy("rank").collect()
    assert [(r["n"], r["k"]) for r in got] == [(5, None), (3, "a"), (3, "b"), (3, None), (None, "c")]


def test_two_checks_of_one_kind_on_one_column(spark):
    rows = spark.createDataFrame([("http://a",), ("ftp://b.example",)], "url string")
    checks = [quality.Check("regex", "url", pattern="^http"), quality.Check("regex", "url", pattern="example$")]
    got = rows_of(quality.report(rows, checks).select("failures", "samples"))
    assert got == [(1, "ftp://b.example"), (1, "http://a")]


def test_repeated_keys_of_a_batch(spark):
    target = spark.createDataFrame([("a", "old", 1), ("c", "old", 1)], "k string, v string, t int")
    batch = spark.createDataFrame(
        [("a", "first", 5, 0), ("a", "last", 9, 1), ("b", "last", None, 3), ("b", "first", 4, 2), (None, "x", 1, 0), (None, "y", 1, 0)],
        "k string, v string, t int, seq int",
    )
    for rows in (batch, batch.orderBy(F.desc("v")).coalesce(1)):
        merged = state.merge(target, rows, ["k"], {"v": lambda old, new: new}, ["seq"], ["t"])
        assert sorted(str(tuple(r)) for r in merged.collect()) == sorted(map(str, [
            ("a", "last", 1), ("b", "last", 4), ("c", "old", 1), (None, "x", 1), (None, "y", 1)]))
    _, inserted = state.insert_new(target, batch.drop("seq"), "k")
    assert inserted.filter("k = 'b'").count() == 1 and inserted.filter("k = 'a'").count() == 0
    _, first = state.insert_new(target.withColumn("seq", F.lit(0)), batch, "k", ["seq"])
    assert [r["v"] for r in first.filter("k = 'b'").collect()] == ["first"]


def test_patterns_with_quotes_and_many_patterns(spark):
    texts = spark.createDataFrame([("it's",), ("n199",), ("none",)], "t string")
    patterns = [("it's", "an 'apostrophe'")] + [(f"^n{i}$", f"v{i}") for i in range(300)]
    got = rows_of(explode_patterns(texts, "t", patterns, "v").filter("v IS NOT NULL"))
    assert got == [("it's", "an 'apostrophe'"), ("n199", "v199")]


def test_dedup_drops_rows_without_key(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("", 1), (None, 1), ("b", 1)], "url string, n int")
    assert rows_of(state.dedup(rows, "url", ["n"])) == [("a", 1), ("b", 1)]


def test_candidates(spark):
    urls = spark.createDataFrame([(f"https://x.example/{i}.html",) for i in (3, 1, 2, 2, 4)], "url string")
    known = spark.createDataFrame([("1",)], "id string")
    assert [r["id"] for r in state.candidates(urls, known, 2).collect()] == ["2", "3"]


def test_gate_lists_failing_checks(spark):
    rows = spark.createDataFrame(
        [("https://a", "d", "r"), ("https://a", "d", None), ("ftp://b", "d", "r")],
        "url string, descriptions string, requirements string",
    )
    with pytest.raises(quality.CheckFailed) as failed:
        quality.require(rows, quality.ITVIEC_CHECKS, "itviec")
    message = str(failed.value)
    assert "unique(url): 2 [https://a]" in message and "not_null(requirements): 1" in message
    assert "regex(url): 1 [ftp://b]" in message and "row_count" not in message
    good = rows.limit(1)
    assert quality.require(good, quality.ITVIEC_CHECKS, "itviec") is good


def test_search_rejects_bad_input(spark):
    rows = spark.createDataFrame([("1", "t")], "id string, title string")
    with pytest.raises(ValueError):
        search.source(rows.withColumn("source", F.lit("x")), "monster")
    with pytest.raises(ValueError):
        search.match(rows, page=0)
    for wrong in ({"page": 1_001}, {"word": "x" * 121}, {"cv_text": "x" * 40_001}):
        with pytest.raises(ValueError):
            search.check_request(**wrong)
    search.check_request("cv", "python", "hà nội", "all", 3)
    assert search.filtered(rows.withColumns({"url": F.lit("u"), "company": F.lit("c")}), "x" * 500).count() == 0


def test_digest_failed_mail_keeps_cursor(spark):
    attached = fixtures.alerts(spark, "/root/testdata/sf0.01")
    jobs = fixtures.jobs_raw(spark, "/root/testdata/sf0.01")
    first = digest.run_digest(attached, jobs, fixtures.as_of())
    sent = {r["alert_id"] for r in first.deliveries.collect()}
    failed = spark.createDataFrame([(a,) for a in sent], "alert_id string")
    second = digest.run_digest(attached, jobs, fixtures.as_of(), failed)
    assert second.deliveries.count() == 0
    before = {r["alert_id"]: r["last_delivered_job_at"] for r in attached.collect()}
    after = {r["alert_id"]: r["last_delivered_job_at"] for r in second.cursors.collect()}
    assert all(after[a] == before[a] for a in sent)
    assert max(len(r["job_ids"]) for r in first.deliveries.collect()) <= 10
    updated = digest.apply_cursors(attached, first.cursors)
    assert digest.due(updated, fixtures.as_of()).join(first.deliveries, "alert_id").count() == 0


TOPCV = """<h1>T1</h1><a class="company company-name" href="/cong-ty/z">C</a>
<div class="job-detail__info--section"><div class="job-detail__info--section-content-title">MỨC LƯƠNG</div>
<div class="job-detail__info--section-content-value">10 triệu</div></div>
<div class="job-detail__info--section"><div class="job-detail__info--section-content-title">Địa điểm</div> Huế</div>
<div class="job-description"><div class="job-description__item"><h3>Mô tả công việc</h3>
<div class="job-description__item--content">x<p>y<p>z<script>var t="</p>";</script></div></div></div>
<div class="job-tags"><a class="item">a</a><a class="item"> </a><a class="item">b</a></div>"""
ITVIEC = """<h1>T2</h1><span class="company-name">C2</span><div class="location">L</div><div class="salary">S</div>
<div class="description">D</div><div class="requirements">R</div><span class="skill-tag">go</span>"""
LINKEDIN = """<h1 class="top-card-layout__title">T3</h1><a class="topcard__org-name-link">C3</a>
<span class="topcard__flavor--bullet">HN</span><div class="show-more-less-html__markup">D3</div>"""


@pytest.mark.parametrize("source, page, expected", [
    ("topcv", TOPCV, ("T1", "C", "Địa điểm Huế", "10 triệu", "x y z", "", "a, b", "https://www.topcv.vn/viec-lam/7.html")),
    ("itviec", ITVIEC, ("T2", "C2", "L", "S", "D", "R", "go", "https://itviec.com/it-jobs/7")),
    ("linkedin", LINKEDIN, ("T3", "C3", "HN", "", "D3", "", "", "https://www.linkedin.com/jobs/view/7")),
])
def test_records_of_every_board(spark, source, page, expected):
    rows = spark.createDataFrame([("7", page), ("8", None)], "page_id string, html string")
    good, bad = pages.split_errors(pages.extract_records(rows, source, F.lit(None).cast("timestamp_ntz")))
    r = good.first()
    assert (r.title, r.company, r.location, r.salary, r.description, r.requirements, r.tags, r.url) == expected
    assert [b.id for b in bad.collect()] == ["8"]


def test_links_of_every_board(spark):
    page = """<div class="job-item-search-result"><h3 class="title"><a href="/viec-lam/1.html?ta=2">x</a></h3></div>
    <h3><a href="/it-jobs/2?lab=1">y</a></h3><a class="base-card__full-link" href="https://vn.linkedin.com/jobs/view/3?x">z</a>"""
    rows = spark.createDataFrame([(page,), (page,)], "html string")
    def found(source, hosts=None):
        return rows_of(pages.discover_links(rows, pages.LINK_SELECTORS[source], "https://b.example", hosts))

    assert found("topcv") == [("https://b.example/viec-lam/1.html",)]
    assert found("itviec") == [("https://b.example/it-jobs/2",)]
    assert found("linkedin", ("vn.linkedin.com", "www.linkedin.com")) == [("https://www.linkedin.com/jobs/view/3",)]


def test_itviec_cards(spark):
    page = """<div class="job-card"><h3 class="imt-3 text-break" data-url="https://i/1?lab_feature=x">T</h3>
    <div class="imy-3 d-flex"><img data-src="l.png"><span>C</span></div><div class="text-rich-grey flex-shrink-0">Hybrid</div>
    <div class="text-rich-grey text-truncate" title="Hà Nội"></div><div class="imt-4 imb-3 d-flex igap-1"><a>go</a><a>k8s</a></div></div>"""
    rows = spark.createDataFrame([(1, page * 2)], "page_id int, html string")
    cards = pages.extract_cards(rows, pages.ITVIEC_CARDS).collect()
    assert len(cards) == 2
    c = cards[0]
    assert (c.title, c.company, c["mode"], c.logo, c.location, c.tags) == ("T", "C", "Hybrid", "l.png", "Hà Nội", "go, k8s")


def test_cards_links_and_bad_pages(spark):
    card = '<div class="job-item-search-result"><h3 class="title">{}</h3><a class="company" href="{}"><span class="company-name">C</span></a></div>'
    html = "".join([card.format('<a href="/viec-lam/1.html?ta_source=x">One</a>', "//www.topcv.vn/cong-ty/a"),
                    card.format("No link", "/cong-ty/b"), card.format('<a href="https://x.example/2">Two</a>', "cong-ty/c")])
    rows = spark.createDataFrame([(1, html), (2, ""), (3, "<![foo[x"), (4, None)], "page_id long, html string")
    got = pages.extract_cards(rows, pages.TOPCV_CARDS, cut="?").select("title", "job_url", "company_url")
    assert rows_of(got) == [("One", "https://www.topcv.vn/viec-lam/1.html", "https://www.topcv.vn/cong-ty/a"),
                            ("Two", "https://x.example/2", "https://www.topcv.vn/cong-ty/c")]
    told = pages.extract_cards(rows, pages.TOPCV_CARDS, errors=True).filter("parse_error IS NOT NULL")
    assert {2, 4} <= {r["page_id"] for r in told.collect()} and told.count() >= 2
    links = pages.discover_links(rows, "h3.title a[href]", "https://b.example", errors=True).collect()
    assert sum(r["url"] is not None for r in links) == 2 and any(r["parse_error"] for r in links)
    assert pages.discover_links(rows, "h3.title a[href]", "https://b.example").count() == 2


def test_deadline_of_any_element(spark):
    spot = '<div class="job-detail__info--deadline">{}</div>'
    rows = spark.createDataFrame([("u", spot.format("Ứng tuyển") + spot.format("Hạn nộp hồ sơ: 1/2/2026")), ("v", spot.format("x"))],
                                 "url string, html string")
    assert rows_of(pages.extract_details(rows).select("url", F.coalesce("deadline", F.lit("")))) == [("u", "1/2/2026"), ("v", "")]


def test_page_files_and_archive(spark, tmp_path):
    folder = tmp_path / "loose" / "source=topcv" / "kind=job_details" / "crawl_date=2024-01-05"
    folder.mkdir(parents=True)
    (folder / "abc.html").write_text("<h1>ệ</h1>", encoding="utf-8")
    loose = archive.scan_page_files(spark, f"{tmp_path}/loose")
    assert [(r.page_id, r.html, r.source) for r in loose.collect()] == [("abc", "<h1>ệ</h1>", "topcv")]
    archive.write_pages(loose, f"{tmp_path}/packed")
    packed = archive.scan_pages(spark, f"{tmp_path}/packed", "topcv", crawl_date="2024-01-05")
    assert packed.count() == 1
    assert "PartitionFilters: [isnotnull" in packed._jdf.queryExecution().executedPlan().toString()


def test_seed_from_file(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text("pattern,target_job_category\n(?i)\\bba\\b,Data Analyst\n", encoding="utf-8")
    assert rows_of(seeds.load_seed(spark, "job_category_mapping", str(path))) == [("(?i)\\bba\\b", "Data Analyst")]


def test_cleaned_markup_and_its_errors(spark):
    markup = {
        1: '<article><p onclick="x()">a &amp; b<br></p><script>bad()</script><a href="javascript:x" title="t">l</a></article>',
        2: '<a href="http://[x">broken</a>', 3: None, 4: '<ul><li>one<li>two</ul><a href="https://a.test/?q=1">go</a>',
    }
    rows = spark.createDataFrame(list(markup.items()), "id long, html string")
    got = {r.id: (r.html, r.parse_error) for r in pages.sanitize_html(rows, "html").collect()}
    extras = 'target="_blank" rel="noopener noreferrer nofollow"'
    assert got[1] == (f'<p>a &amp; b<br /></p><a title="t" {extras}>l</a>', None)
    assert got[2][0] is None and got[2][1].startswith("ValueError")
    assert got[3] == (None, None)
    assert got[4] == (f'<ul><li>one<li>two</li></li></ul><a href="https://a.test/?q=1" {extras}>go</a>', None)


def test_ranks_over_many_equal_values_and_nulls(spark):
    """A million rows, most of one value: the same numbers as row_number, and no task with most of the rows."""
    rows = spark.range(1_000_000).select(
        F.when(F.col("id") % 10 < 8, F.lit(5)).when(F.col("id") % 10 == 8, F.col("id")).alias("n"),
        F.when(F.col("id") % 1000 != 1, F.md5(F.col("id").cast("string"))).alias("key"), "id")
    ranked = measures.global_rank(rows, "n", "key", "rank")
    numbers = ranked.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()
    assert tuple(numbers) == (1_000_000, 1, 1_000_000)
    # Rows without a key come behind all others of their value, so numbers inside a value agree with the window's.
    behind = ranked.groupBy("n").agg(
        F.max(F.when(F.col("key").isNotNull(), F.col("rank"))).alias("last"),
        F.min(F.when(F.col("key").isNull(), F.col("rank"))).alias("first")).where("last > first")
    assert behind.count() == 0
    plain = rows.selectExpr("id", "n", "key", "row_number() OVER (ORDER BY n DESC NULLS LAST, key ASC NULLS LAST) AS expected")
    assert ranked.join(plain, "id").where(ranked["key"].isNotNull() & (F.col("rank") != F.col("expected"))).count() == 0
    plan = ranked._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert measures.global_rank(rows.limit(0), "n", "key", "rank").count() == 0
