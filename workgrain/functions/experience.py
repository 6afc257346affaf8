"""Experience and education text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, trim_blanks

# Cue patterns of experience texts.
SPAN = r"(?iu)(\d+\s*(-|–|đến|to)\s*\d+\+?)\s*(năm|years?)"
HAS_PLUS = r"(?iu)\d+\s*\+\s*(năm|years|year?)"
PLUS = r"(?iu)(\d+\s*\+)\s*(năm|years?)"
BELOW = r"(?iu)(dưới|below|less than)\s*(\d+)\s*(năm|years?)"
LEAST = r"(?iu)(tối thiểu|ít nhất|trên|at least|minimum)\s*(\d+)\s*(năm|years?)"
SINGLE = r"(?iu)(\d+)\s*(năm|years?)"


def education_level(c: Column) -> Column:
    return (
        F.when(contains_any(c, "cao đẳng", "college"), F.lit("College"))
        .when(contains_any(c, "đại học", "bachelor"), F.lit("Bachelor"))
        .when(contains_any(c, "thạc sĩ", "master"), F.lit("Master"))
        .when(contains_any(c, "tiến sĩ", "phd"), F.lit("PhD"))
        .otherwise(F.lit("Unknown"))
    )


def experience_level(c: Column) -> Column:
    """Seniority of the active mart, by substring (``11 năm`` also holds ``1 năm``)."""
    return (
        F.when(contains_any(c, "Không yêu cầu", "Dưới 1 năm"), F.lit("Fresher / Junior"))
        .when(contains_any(c, "1 năm", "2 năm", "3 năm"), F.lit("Mid-level"))
        .when(contains_any(c, "4 năm", "5 năm"), F.lit("Senior"))
        .otherwise(F.lit("Chưa xác định"))
    )


def experience_months(c: Column) -> Column:
    """Months of experience asked for; 0 for beginner words, null when unknown."""
    s = trim_blanks(F.lower(c))
    years = F.regexp_extract(s, r"(\d+)\s*\+?\s*(năm|nam|year|yr)", 1).try_cast("bigint")
    months = F.regexp_extract(s, r"(\d+)\s*(tháng|thang|month|mo)(?![A-Za-z0-9_])", 1)
    return F.when(
        s.rlike(r"không|chưa|fresher|intern|thực tập|no exp|0\s*năm"), F.lit(0).cast("bigint")
    ).otherwise(F.coalesce(years * 12, months.try_cast("bigint")))


def _group(c: Column, pattern: str, group: int) -> Column:
    """A regex group, null (not empty) without a match."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def experience_phrase(c: Column) -> Column:
    """``a - b``, ``n+``, ``n-`` (below n), ``n+`` (at least n), ``n`` or ``Unknown``."""
    return (
        F.when(c.rlike(SPAN), _group(c, SPAN, 1))
        .when(c.rlike(HAS_PLUS), _group(c, PLUS, 1))
        .when(c.rlike(BELOW), F.concat(_group(c, BELOW, 2), F.lit("-")))
        .when(c.rlike(LEAST), F.concat(_group(c, LEAST, 2), F.lit("+")))
        .when(c.rlike(SINGLE), _group(c, SINGLE, 1))
        .otherwise(F.lit("Unknown"))
    )


def experience_years(phrase: Column) -> Column:
    """Number behind a phrase: ``n``, ``n+`` → n, ``n-`` → n/2, ``a-b`` → mean."""
    p = F.regexp_replace(F.lower(phrase), "[–—]", "-")
    first = F.regexp_extract(p, "^([0-9]+)", 1).try_cast("double")
    second = F.regexp_extract(p, "-([0-9]+)", 1).try_cast("double")
    return (
        F.when(p.rlike(r"^[0-9]+\+?$"), first)
        .when(p.rlike("^[0-9]+-$"), first / 2)
        .when(p.rlike(r"^[0-9]+-[0-9]+\+?$"), (first + second) / 2)
    )


# Lower limits, band labels and level labels.
_STEPS = [
    (1, "0-1 year", "Intern / Fresher"),
    (3, "1-3 years", "Junior"),
    (5, "3-5 years", "Mid-level"),
    (8, "5-8 years", "Senior"),
]


def _stepped(years: Column, index: int, last: str) -> Column:
    label = F.when(years.isNull(), F.lit("Unknown"))
    for step in _STEPS:
        label = label.when(years < step[0], F.lit(step[index]))
    return label.otherwise(F.lit(last))


def experience_band(years: Column) -> Column:
    return _stepped(years, 1, "8+ years")


def experience_rank(years: Column) -> Column:
    return _stepped(years, 2, "Lead / Principal")
