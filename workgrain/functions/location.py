"""Location text and work-model normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, trim_blanks

# City names of the active mart with the spellings they are known by.
CITY_BUCKETS = [
    ("Hà Nội", ("Hà Nội", "Hanoi")),
    ("Hồ Chí Minh", ("Hồ Chí Minh", "Ho Chi Minh", "District 9")),
    ("Đà Nẵng", ("Đà Nẵng", "Da Nang", "Đà Nang")),
    ("Hải Phòng", ("Hải Phòng", "Hai Phong")),
    ("Cần Thơ", ("Cần Thơ", "Can Tho")),
]
# Spellings used by search, dashboard and alerts.
HANOI = ("hà nội", "ha noi")
HCMC = ("hồ chí minh", "ho chi minh", "hcm")
DANANG = ("đà nẵng", "da nang")
OTHER_CITY = "Khác"


def city_bucket(c: Column) -> Column:
    (name, spellings), *rest = CITY_BUCKETS
    bucket = F.when(contains_any(c, *spellings), F.lit(name))
    for name, spellings in rest:
        bucket = bucket.when(contains_any(c, *spellings), F.lit(name))
    return bucket.otherwise(F.lit(OTHER_CITY))


def dashboard_city(c: Column) -> Column:
    return (
        F.when(contains_any(c, *HANOI), F.lit("Hà Nội"))
        .when(contains_any(c, *HCMC), F.lit("Hồ Chí Minh"))
        .otherwise(F.lit(OTHER_CITY))
    )


def normal_location(c: Column) -> Column:
    """Lower case, ``(mới)`` dropped, ``&`` read as a list separator."""
    low = F.replace(F.lower(c), F.lit("(mới)"), F.lit(""))
    return trim_blanks(F.replace(low, F.lit("&"), F.lit("-")))


# Accepted spellings of work models and arrangements.
WORK_MODELS = {
    "Hybrid": ("hybrid", "lai"),
    "Remote": ("remote", "từ xa"),
    "On-Site": ("at office", "tại văn phòng", "on-site", "on site"),
}
ARRANGEMENTS = {
    "Full-time": ("toàn thời gian", "full-time", "full time", "fulltime"),
    "Part-time": ("bán thời gian", "part-time", "part time"),
    "Internship": ("thực tập", "internship", "intern"),
}


def _normal_form(c: Column, forms: dict[str, tuple[str, ...]]) -> Column:
    clean = trim_blanks(c)
    result = None
    for name, spellings in forms.items():
        test = F.lower(clean).isin(*spellings)
        result = F.when(test, F.lit(name)) if result is None else result.when(test, F.lit(name))
    return result.otherwise(clean)


def work_model(c: Column) -> Column:
    return _normal_form(c, WORK_MODELS)


def work_arrangement(c: Column) -> Column:
    return _normal_form(c, ARRANGEMENTS)
