"""The one-pass reader beside the tree, and the batches that page work hands on."""

from __future__ import annotations

import gc
import random

import pyarrow as pa
from pyspark.sql import functions as F

from workgrain.functions.html import Selectors, read, tree
from workgrain.operators import pages

PIECES = [
    "<div class='a b'>", "</div>", "<p id=x>", "</P>", "<ul>", "<li class=b>", "</ul>", "<img class=b src='>'>", "<b/>", "x &amp; y", " z\n",
    "<script>var t = '</p>';</script>", "<template>t<p>u</template>", "<title>a <b> c</title>", "<textarea>q", "<!-- <p> -->", "<!doctype html>",
    "<p data-k='vv'>", "1 < 2", "</span>", "<span>", "<STYLE>p{}</style>", "&lt;", "&nbsp;", "<a href='u?a=1&amp;b=2'>", "</a>", "<!--",
]
SELECTORS = ["p", ".b", "div .b", "#x", "p.b", "[data-k]", "p[data-k^='v']", "ul li, img", "div p", "*[class]", "template", "template p", "script", "title", "a[href]"]


def test_reader_gives_what_the_tree_gives():
    rng, selectors = random.Random(5), Selectors(SELECTORS)
    for _ in range(3000):
        page = "".join(rng.choice(PIECES) for _ in range(rng.randrange(25)))
        root = tree(page)
        want, (top, got) = Selectors(SELECTORS).find(root), read(page, selectors)
        assert top.text() == root.text()
        for s in SELECTORS:
            a, b = want.below(root, s), got.below(top, s)
            assert [(n.tag, n.attrs, n.at, n.end, n.text()) for n in a] == [(n.tag, n.attrs, n.at, n.end, n.text()) for n in b]
            for x, y in zip(a, b, strict=True):
                assert [n.at for n in want.below(x, "p")] == [n.at for n in got.below(y, "p")]


def test_reader_leaves_no_cycles():
    page, selectors = "<div class=b><p>x</p></div>" * 50, Selectors(SELECTORS)
    gc.collect()
    gc.disable()
    try:
        read(page, selectors)
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_rows_of_large_pages_leave_in_several_batches(spark, monkeypatch):
    kept = []

    class Pages:
        columns = ["page_id", "html"]
        schema = spark.createDataFrame([], "page_id long, html string").schema

        def mapInArrow(self, run, schema):
            return run

    run = pages.parse(Pages(), pages.Spec(lists={"p": "p"}))
    html = ["<p>" + "x" * 300_000 + "</p>"] * 8 + [None]
    for part in run(iter([pa.record_batch({"page_id": pa.array(range(9)), "html": pa.array(html)})])):
        kept.append(part.num_rows)
    assert sum(kept) == 9 and max(kept) < 5


def test_page_work_is_dealt_to_as_many_tasks_as_the_session_shuffles_into(spark):
    from workgrain.plans import pages as plans
    from workgrain.plans.registry import QUERIES

    small = "/root/testdata/sf0.001"
    plan = plans.detail_pages(plans.topcv_jobs(spark, small))._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan
    for name in ("h7_two_templates", "h8_list_cards", "h11_assemble"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, small)._jdf.queryExecution().toString()
    assert plans.topcv_jobs(spark, small).where(F.col("source") != "topcv").isEmpty()
