"""Steps that were reworked for size: keys of postings, cleaned markup."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from workgrain.operators import digest, matching, pages


def runs_of(text: str) -> set[str]:
    return {text[i : i + n] for n in range(1, 4) for i in range(max(len(text) - n + 1, 1))}


def test_wanted_keys_are_offered_once_and_without_lambdas(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "ab", "đà nẵng", "aaaa", "😀b😀b"] + ["".join(rng.choice("ab đ😀") for _ in range(rng.randrange(9))) for _ in range(60)]
    rows = [(i, rng.choice(texts), rng.choice(texts), rng.choice(texts), [f"f:{x}" for x in range(rng.randrange(3))]) for i in range(150)]
    given = spark.createDataFrame(rows, "i int, t string, u string, p string, f array<string>")
    wanted = ["k:", "p:", "k:a", "k:ab", "k:aba", "k:b😀b", "p:đ ", "p:aaa", "p:nẵn", "f:0", "f:1", "k:zzz"]
    keys = spark.createDataFrame([(w,) for w in wanted], "key string")
    found = matching.explode_wanted(given, [("k:", F.col("t")), ("k:", F.col("u")), ("p:", F.col("p"))], keys, F.col("f"))
    got = Counter((r["i"], r["key"]) for r in found.join(keys, "key").collect())
    want = Counter((i, k) for i, t, u, p, f in rows for k in {
        *(f"k:{r}" for x in (t, u) if x is not None for r in runs_of(x)), *(f"p:{r}" for r in runs_of(p or "") if p is not None), *f} if k in wanted)
    assert got == want and found.columns == ["i", "t", "u", "p", "f", "key"]
    assert matching.explode_wanted(given, [("", F.col("t"))], keys.limit(0)).count() == 0
    plan = matching.explode_wanted(given, [("", F.col("t"))], keys)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in "\n".join(line for line in plan.splitlines() if "__text" in line)


def test_only_postings_after_a_filters_first_cutoff_are_paired(spark):
    filters = spark.createDataFrame([("a", "x", "2001-01-02"), ("b", "x", "2001-01-09")], "filter string, keyword string, since string")
    wanted = F.struct(F.col("keyword"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("salary"))
    filters = filters.select("filter", wanted.alias("wanted"), F.col("since").cast("timestamp_ntz").alias("since"))
    jobs = spark.createDataFrame([("1", "2001-01-02", "x"), ("2", "2001-01-03", "xx x"), ("3", "2001-02-01", "X"), ("4", "2001-02-01", None)], "job_id string, at string, title string")
    jobs = jobs.select("job_id", F.col("at").cast("timestamp_ntz").alias("job_at"), "title", *[F.lit(None).cast("string").alias(c) for c in ("company", "location", "salary")])
    assert sorted(map(tuple, digest.match_filters(filters, jobs).select("filter", "job_id").collect())) == [("a", "2"), ("a", "3"), ("b", "3")]
    assert digest.match_filters(filters.drop("since"), jobs).count() == 6


def test_cleaned_markup_leaves_before_its_batch_is_through(spark, monkeypatch):
    caught, real = [], F.arrow_udf
    monkeypatch.setattr(pages.F, "arrow_udf", lambda kind: lambda f: caught.append(f) or real(kind)(f))
    rows = spark.createDataFrame([(i, "<p>x</p>" if i % 3 else None) for i in range(50)], "i int, h string")
    cleaned = pages.sanitize_html(rows, "h")
    assert [r["h"] for r in cleaned.orderBy("i").collect()] == ["<p>x</p>" if i % 3 else None for i in range(50)]
    taken = []

    def given():
        for _ in range(2):
            taken.append(len(taken))
            yield pa.array(["<p>" + "x" * 300_000 + "</p>"] * 20 + [None, ""])

    sizes = []
    for part in caught[0](given()):
        sizes.append((len(taken), len(part)))
    assert sum(n for _, n in sizes) == 44 and max(n for _, n in sizes) <= 6
    assert sum(n for at, n in sizes if at == 1) == 22
