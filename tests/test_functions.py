from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from workgrain.functions import (
    alerts, dates, experience, labels, location, posting, salary, skills, text, vectors,
)
from workgrain.functions.html import clean_html
from workgrain.sources.seeds import CATEGORY_PATTERNS, CITY_PATTERNS


@pytest.mark.parametrize("raw, shown", [
    ("data/ai engineer", "Data/Ai Engineer"),
    ("  kỹ sư (mới) ", "Kỹ Sư (Mới)"),
    ("it's part-time", "It'S Part-Time"),
    ("ĐÀ NẴNG", "Đà Nẵng"),
    ("", ""), (None, None),
])
def test_title_case(one, raw, shown):
    assert one(text.title_case, raw) == shown


@pytest.mark.parametrize("name, slug", [
    ("MoMo (M_Service)", "momo-m-service"),
    ("Techcombank (TCB)", "techcombank-tcb"),
    ("Công ty Đà Nẵng Ωmega", "cong-ty-da-nang-mega"),
    ("Đà".replace("à", "à"), "da"),
    ("---", ""), (None, None),
])
def test_slug(one, name, slug):
    assert one(text.slug, name) == slug


@pytest.mark.parametrize("url, safe", [
    ("javascript:alert(1)", None),
    ("HTTPS://Example.COM", "https://example.com/"),
    ("http://a.b?x=1", "http://a.b/?x=1"),
    ("https://a.b/C?d#e", "https://a.b/C?d#e"),
    ("", None), (None, None),
])
def test_http_url(one, url, safe):
    assert one(text.http_url, url) == safe


@pytest.mark.parametrize("url, segment", [
    ("https://x.example/viec-lam/abc.html", "abc"), ("https://x.example/abc//", "abc"), ("abc", "abc"),
])
def test_last_segment(one, url, segment):
    assert one(text.last_segment, url) == segment


def test_ellipsis_and_tags(one):
    assert one(lambda c: text.ellipsis(c, 5), "abcdef") == "abcd…"
    assert one(lambda c: text.ellipsis(c, 5), None) == "N/A"
    assert one(text.strip_tags, "<p>a&nbsp;b</p>\n c <br") == "a b c"


@pytest.mark.parametrize("raw, pay", [
    ("20,000,000 - 30,000,000 VNĐ", ("VND", 2e7, 3e7, None)),
    ("1.000 - 2.000 USD", ("USD", 1000, 2000, None)),
    ("Từ 1,5 triệu", ("VND", 1.5e6, None, None)),
    ("Tới 30 triệu", ("VND", None, 3e7, None)),
    ("15 triệu", ("VND", None, None, 1.5e7)),
    ("$500", ("USD", None, None, 500)),
    ("20 - 30", None), ("Thoả thuận", None), ("0 USD", None), ("", None), (None, None),
])
def test_parse_salary(one, raw, pay):
    found = one(salary.parse_salary, raw)
    assert (None if found is None else tuple(found)) == pay


@pytest.mark.parametrize("raw, low, high", [
    ("10 - 20 triệu", 10_000_000, 20_000_000),
    ("500 - 1000 usd", 12_000_000, 24_000_000),
    ("Từ 8 Triệu", 8_000_000, None),
    ("Upto 30 Triệu", None, 30_000_000),
    ("3000 - 4000 Triệu", 3_000_000_000, 4_000_000_000),
    ("Negotiable", None, None), ("", None, None), (None, None, None),
])
def test_salary_bounds(one, raw, low, high):
    assert (one(salary.min_salary, raw), one(salary.max_salary, raw)) == (low, high)


def test_salary_bands(spark):
    rows = spark.createDataFrame([(None,), (9e6,), (1e7,), (9.9e7,), (1e8,)], "c double")
    shown = [r[0] for r in rows.select(salary.salary_band(F.col("c"))).collect()]
    assert shown == ["Not Specified", "Below 10M VND", "10-20M VND", "90-100M VND", "Above 100M VND"]


@pytest.mark.parametrize("raw, phrase, years", [
    ("3-5 years", "3-5", 4.0), ("từ 3 đến 5 năm", "3 đến 5", None), ("3+ years", "3+", 3.0),
    ("dưới 1 năm", "1-", 0.5), ("at least 5 years", "5+", 5.0), ("2 năm", "2", 2.0),
    ("5+ yea", None, None), ("nothing", "Unknown", None), (None, "Unknown", None),
])
def test_experience_phrase(one, raw, phrase, years):
    assert one(experience.experience_phrase, raw) == phrase
    assert one(lambda c: experience.experience_years(experience.experience_phrase(c)), raw) == years


@pytest.mark.parametrize("raw, months", [
    ("Không yêu cầu", 0), ("10 năm", 0), ("3 năm", 36), ("6 tháng", 6), ("6 mother", None), (None, None),
])
def test_experience_months(one, raw, months):
    assert one(experience.experience_months, raw) == months


def test_levels(one):
    assert one(experience.experience_level, "11 năm") == "Mid-level"
    assert one(experience.education_level, "Tốt nghiệp ĐẠI HỌC") == "Bachelor"
    assert one(location.city_bucket, "tp. HỒ CHÍ MINH") == "Hồ Chí Minh"
    assert one(location.city_bucket, None) == "Khác"
    assert one(location.work_model, " Từ xa ") == "Remote"


@pytest.mark.parametrize("raw, found", [
    ("React Native and react, C++ c# .NET", ["react", "react native", ".net", "c++", "c#"]),
    ("ễgo nhé", ["go"]), ("golang mongodb", ["golang", "mongodb"]), ("ASP NET", ["asp.net"]),
    ("UI/UX scikit-learn", ["scikit-learn", "ui/ux"]), ("goes javas", []), (None, []),
])
def test_skills(one, raw, found):
    assert one(skills.extract_skills, raw) == found


def test_skill_gap(spark):
    def gap(cv, job):
        rows = spark.createDataFrame([(cv, job)], "a array<string>, b array<string>")
        return tuple(rows.select(skills.skill_gap(F.col("a"), F.col("b")).alias("g")).first()["g"])

    assert gap(["go"], ["go", "rust", "java"]) == (["go"], ["rust", "java"], 33)
    assert gap(["go"], []) == ([], [], None)


def test_city_patterns_cover_every_province():
    assert len(CITY_PATTERNS) == 63 and len(CATEGORY_PATTERNS) == 7
    by_code = {row[1]: row for row in CITY_PATTERNS}
    assert by_code["thua_thien_hue"][2] == "Thua Thien Hue"
    assert by_code["ba_ria_vung_tau"][0].startswith(r"bà\s*rịa\s*[- ]?\s*vũng\s*tàu|")


def test_unknown_zones_are_not_due(spark):
    rows = spark.createDataFrame([("Asia/Ho_Chi_Minh",), ("Mars/Base",), ("",), (None,), ("UTC",)], "zone string")
    now = F.expr("timestamp_ntz '2026-01-01 01:00:00'")
    due = alerts.is_due(F.col("zone"), F.lit(None).cast("timestamp_ntz"), now)
    assert [r[0] for r in rows.select(due).collect()] == [True, False, False, False, False]


def test_scripts_and_styles_are_not_text(one):
    from workgrain.functions import text

    raw = "<p>a</p><SCRIPT type='x'>var t = '<p>no</p>';\n</script ><style>p {}</style> b<scripted>c"
    assert one(text.strip_tags, raw) == "a bc"


def test_alert_filters(one):
    cleaned = one(alerts.clean_filters, '{"salary":"invalid","keyword":"all","role":"data"}')
    assert {k: v for k, v in cleaned.asDict().items() if v} == {"role": "data"}
    given = '{"category":"data-engineer","level":"all","keyword":"python"}'
    assert one(alerts.unsupported_filters, given) == "category"
    assert one(alerts.unsupported_filters, "[1]") == ""
    assert one(lambda c: alerts.clean_filters(c)["keyword"], '{"keyword": 5}') is None


JOB = {
    "title": "Senior Data Engineer", "company": "Aurora Labs", "location": "Hà Nội & Remote",
    "salary": "20,000,000 - 30,000,000 VNĐ", "category": None, "experience": "3 năm", "level": None,
}


@pytest.mark.parametrize("changes, filters, expected", [
    ({}, {"salary": "20to30"}, True),
    ({}, {"location": "Hà Nội"}, True),
    ({}, {"keyword": "AURORA"}, True),
    ({"location": "Hồ Chí Minh"}, {"location": "TP.Hồ Chí Minh"}, True),
    ({"salary": "1.000 - 2.000 USD"}, {"salary": "usd_1kto2k"}, True),
    ({"salary": None}, {"salary": "deal"}, True),
    ({"salary": None}, {"salary": "under10"}, False),
    ({"location": None}, {"location": "other"}, False),
    ({"location": "Cần Thơ"}, {"location": "other"}, True),
    ({}, {"category": "data"}, False),
    ({}, {}, True),
])
def test_alert_predicate(spark, changes, filters, expected):
    schema = ", ".join(f"{k} string" for k in JOB)
    rows = spark.createDataFrame([tuple({**JOB, **changes}.values())], schema)
    wanted = alerts.clean_filters(F.lit(json.dumps(filters)))
    assert rows.select(alerts.matches({k: F.col(k) for k in JOB}, wanted).alias("m")).first()["m"] is expected


def test_posting_document(spark):
    row = spark.createDataFrame(
        [("Intern <b>", None, "a & b", "Huế", "Từ 1,5 triệu", "6 tháng", datetime(2026, 1, 1), "u")],
        "t string, c string, d string, l string, s string, e string, at timestamp_ntz, u string",
    )
    doc = row.select(posting.posting_document(*[F.col(c) for c in "t c d l s e at u".split()]).alias("d")).first()["d"]
    assert "<" not in doc and "&" not in doc
    read = json.loads(doc)
    assert read["title"] == "Intern <b>" and "hiringOrganization" not in read
    assert read["baseSalary"]["value"] == {"@type": "QuantitativeValue", "minValue": 1500000, "unitText": "MONTH"}
    assert read["validThrough"] == "2026-01-15T00:00:00.000Z"
    assert read["employmentType"] == "INTERN"
    assert read["experienceRequirements"]["monthsOfExperience"] == 6


def test_relative_age(spark):
    now = datetime(2026, 3, 1, 12)
    cases = [
        (datetime(2026, 3, 1, 12), "Vừa đăng"), (datetime(2026, 3, 1, 11, 30), "30 phút trước"),
        (datetime(2026, 3, 1, 9), "3 giờ trước"), (datetime(2026, 2, 28, 9), "Hôm qua"),
        (datetime(2026, 2, 20), "9 ngày trước"), (datetime(2026, 1, 20), "1 tháng trước"),
        (datetime(2025, 11, 1), "4 tháng trước"), (None, ""),
    ]
    rows = spark.createDataFrame([(i, c[0], now) for i, c in enumerate(cases)], "i int, t timestamp_ntz, n timestamp_ntz")
    shown = rows.orderBy("i").select(dates.relative_age(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in shown] == [c[1] for c in cases]


def test_snippet_default(spark):
    row = spark.createDataFrame([("T", None, "", None, None, None)], "t string, c string, d string, s string, l string, e string")
    shown = row.select(labels.snippet(*[F.col(c) for c in "tcdsle"], "Site").alias("v")).first()["v"]
    assert shown == "Việc làm T tại công ty — Site"


def test_vectors(spark):
    rows = spark.createDataFrame([("a",), (None,)], "t string")
    made = rows.select("t", vectors.encode_text(F.col("t")).alias("v"))
    for r in made.collect():
        assert len(r["v"]) == 384 and abs(sum(x * x for x in r["v"]) - 1) < 1e-5
    odd = spark.createDataFrame([([1.0, 0.0],), ([3.0, 4.0],), ([1.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    found = [r[0] for r in odd.select(vectors.cosine_similarity(F.col("v"), [2.0, 0.0])).collect()]
    assert found == [1.0, pytest.approx(0.6), None, None, None]


def test_wrong_encoder_fails_the_batch(spark):
    rows = spark.createDataFrame([("a",)], "t string")
    with pytest.raises(Exception, match="expected 1 vectors of 384"):
        rows.select(vectors.encode_text(F.col("t"), lambda texts: [[1.0]])).collect()


@pytest.mark.parametrize("raw, clean", [
    ('<p onclick="x">a<script>b</script></p>', "<p>a</p>"),
    ('<a href="javascript:x" title="t">l</a>', '<a title="t" target="_blank" rel="noopener noreferrer nofollow">l</a>'),
    ('<a href="/x">l</a>', '<a href="/x" target="_blank" rel="noopener noreferrer nofollow">l</a>'),
    ("a<button>Show <b>more</b></button>b<br>c", "ab<br />c"),
    ("x\n \n\n\ny", "x\n\ny"), ("<section>1 &lt; 2</section>", "1 &lt; 2"), ("<b>open", "<b>open</b>"),
])
def test_clean_html(raw, clean):
    assert clean_html(raw) == clean


def test_entry_survives_a_missing_package(tmp_path):
    """Without a package of the optional operators, the other queries are registered and a warning names it."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    code = (
        "import sys, warnings; sys.modules['zstandard'] = None; warnings.simplefilter('always')\n"
        "import __spark_entry__ as e; q = e.queries(); print(len(q), 'a1_job_category_analysis' in q or 'a1' in str(list(q)))"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 150
    if (root / "workgrain" / "llm").exists():
        assert "zstandard" in out.stderr
