"""Calendar parts, day differences and relative ages. Time enters as ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def calendar_parts(day: Column) -> dict[str, Column]:
    return {
        "month": F.month(day),
        "quarter": F.quarter(day),
        "year": F.year(day),
        "day_of_month": F.dayofmonth(day),
        "week_of_year": F.weekofyear(day),
        "month_of_year": F.month(day),
    }


def days_active(first: Column, as_of: Column) -> Column:
    """Days since the first posting, both ends counted."""
    return F.datediff(as_of, first) + 1


def relative_age(ts: Column, as_of: Column) -> Column:
    """Age in words, from minutes to months."""
    minutes = F.timestamp_diff("MINUTE", ts, as_of)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)

    def words(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit} trước"))

    return (
        F.when(ts.isNull(), F.lit(""))
        .when(minutes < 1, F.lit("Vừa đăng"))
        .when(minutes < 60, words(minutes, "phút"))
        .when(hours < 24, words(hours, "giờ"))
        .when(days == 1, F.lit("Hôm qua"))
        .when(days < 30, words(days, "ngày"))
        .when(days < 60, F.lit("1 tháng trước"))
        .otherwise(words(F.floor(days / 30), "tháng"))
    )


def job_age(posted: Column, crawled: Column, as_of: Column) -> Column:
    """Age of a posting; a date without a time on the crawl day means the crawl time."""
    date_only = (posted == F.date_trunc("DAY", posted)) & (F.to_date(posted) == F.to_date(crawled))
    return relative_age(F.when(posted.isNull() | date_only, crawled).otherwise(posted), as_of)
