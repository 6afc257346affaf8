"""Display names, default labels, snippets and run-ledger classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_tags

# Names shown for the sources.
SOURCE_NAMES = {
    "topcv": "TopCV",
    "linkedin": "LinkedIn",
    "itviec": "ITViec",
    "vieclam24h": "Việc Làm 24h",
}
# Texts shown for missing fields.
DEFAULTS = {
    "title": "Chưa có tiêu đề",
    "company": "Không rõ công ty",
    "url": "",
    "source": "unknown",
}


def source_name(c: Column, names: dict[str, str] | None = None) -> Column:
    names = names or SOURCE_NAMES
    shown = c
    for key, label in names.items():
        shown = F.when(c == key, F.lit(label)).otherwise(shown)
    return shown


def with_default(c: Column, field: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(DEFAULTS[field]))


def snippet(
    title: Column, company: Column, description: Column, salary: Column,
    location: Column, experience: Column, site: str,
) -> Column:
    """Page summary: 160 characters of the description, else the known facts."""
    def filled(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    facts = F.concat_ws(
        " · ",
        F.concat(F.lit("Mức lương: "), filled(salary)),
        filled(location),
        filled(experience),
    )
    text = F.when(
        filled(description).isNotNull(), F.substring(strip_tags(description), 1, 160)
    ).otherwise(F.substring(facts, 1, 200))
    default = F.concat(
        F.lit("Việc làm "), title, F.lit(" tại "),
        F.coalesce(company, F.lit("công ty")), F.lit(f" — {site}"),
    )
    return F.coalesce(filled(text), default)


def ledger_source(task: Column) -> Column:
    return _first_named(task, ("itviec", "topcv", "bronze", "silver", "gold"))


def ledger_layer(task: Column) -> Column:
    return _first_named(task, ("bronze", "silver", "gold", "staging"))


def ledger_type(task: Column) -> Column:
    low = F.lower(task)
    return F.when(low.contains("bash") | low.contains("dbt"), F.lit("bash")).otherwise(F.lit("python"))


def _first_named(task: Column, names: tuple[str, ...]) -> Column:
    low = F.lower(task)
    result = F.when(low.contains(names[0]), F.lit(names[0]))
    for name in names[1:]:
        result = result.when(low.contains(name), F.lit(name))
    return result
