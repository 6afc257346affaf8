"""Structured posting document, employment type and embedding text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .experience import experience_months
from .salary import parse_salary
from .text import let

VALID_DAYS = 14


def employment_type(title: Column) -> Column:
    s = F.lower(F.coalesce(title, F.lit("")))
    word = "(?<![A-Za-z0-9_]){}(?![A-Za-z0-9_])".format
    return (
        F.when(s.rlike("intern|thực tập|thuc tap"), F.lit("INTERN"))
        .when(s.rlike(r"part[\s-]?time|bán thời gian|ban thoi gian"), F.lit("PART_TIME"))
        .when(
            s.rlike(f"{word('contract')}|freelance|cộng tác viên|{word('ctv')}"),
            F.lit("CONTRACTOR"),
        )
        .otherwise(F.lit("FULL_TIME"))
    )


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _typed(kind: str, *fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("@type"), *fields)


def posting_document(
    title: Column, company: Column, description: Column, location: Column, salary: Column,
    experience: Column, created: Column, url: Column,
    posted: Column | None = None, last_seen: Column | None = None,
) -> Column:
    """JSON posting object; null fields are left out, ``< > &`` are escaped."""
    published = created if posted is None else F.coalesce(posted, created)
    newest = published if last_seen is None else F.coalesce(last_seen, published)

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def base_salary(pay: Column) -> Column:
        value = _typed(
            "QuantitativeValue",
            pay["value"].try_cast("bigint").alias("value"),
            pay["min"].try_cast("bigint").alias("minValue"),
            pay["max"].try_cast("bigint").alias("maxValue"),
            F.lit("MONTH").alias("unitText"),
        )
        amount = _typed("MonetaryAmount", pay["currency"].alias("currency"), value.alias("value"))
        return F.when(pay.isNotNull(), amount)

    def requirement(months: Column) -> Column:
        asked = _typed("OccupationalExperienceRequirements", months.alias("monthsOfExperience"))
        return F.when(months.isNotNull(), asked)

    place = _typed(
        "PostalAddress",
        location.alias("addressLocality"),
        location.alias("addressRegion"),
        F.lit("VN").alias("addressCountry"),
    )
    document = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("JobPosting").alias("@type"),
        title.alias("title"),
        F.coalesce(given(description), title).alias("description"),
        _iso(published).alias("datePosted"),
        _iso(newest + F.expr(f"INTERVAL {VALID_DAYS} DAYS")).alias("validThrough"),
        F.when(given(company).isNotNull(), _typed("Organization", company.alias("name"))).alias(
            "hiringOrganization"
        ),
        F.when(given(location).isNotNull(), _typed("Place", place.alias("address"))).alias(
            "jobLocation"
        ),
        employment_type(title).alias("employmentType"),
        let(experience_months(experience), requirement).alias("experienceRequirements"),
        let(parse_salary(salary), base_salary).alias("baseSalary"),
        F.lit(False).alias("directApply"),
        url.alias("url"),
    )
    text = F.to_json(document)
    for char in ("<", ">", "&", "\u2028", "\u2029"):
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return text


def embedding_text(title: Column, experience: Column, description: Column, requirements: Column) -> Column:
    """Labelled text of four fields, empty where a field is missing."""
    def filled(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return F.concat(
        F.lit("Title: "), filled(title), F.lit(". Experience: "), filled(experience),
        F.lit(". Description: "), filled(description), F.lit(". Requirements: "), filled(requirements),
    )


def embedding_text_short(title: Column, requirements: Column, description: Column) -> Column:
    """Labelled text of three fields with tags taken out; missing fields read ``null``."""
    def shown(c: Column) -> Column:
        return F.coalesce(c, F.lit("null"))

    text = F.concat(
        F.lit("Title: "), shown(title), F.lit("\nRequirements: "), shown(requirements),
        F.lit("\nDescription: "), shown(description),
    )
    return F.regexp_replace(text, "<[^>]*>?", "")
