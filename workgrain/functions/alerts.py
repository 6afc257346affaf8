"""Saved-alert filters: cleaning, due test and the match predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .location import DANANG, HANOI, HCMC
from .salary import parse_salary
from .text import let, trim_blanks

# Filter keys with their length caps, keys postings cannot answer,
# salary choices, local send hour and the guards around it.
KEY_CAPS = {
    "category": 60, "role": 60, "keyword": 100, "location": 60,
    "experience": 60, "level": 60, "salary": 60,
}
UNSUPPORTED_KEYS = ("category", "role", "experience", "level")
SALARY_CHOICES = (
    "all", "deal", "under10", "10to20", "20to30", "30to50", "over50",
    "usd_under1k", "usd_1kto2k", "usd_over2k",
)
SEND_HOUR = 8
RESEND_GUARD_HOURS = 23
NEW_ALERT_COOLDOWN_HOURS = 1
LOOKBACK_HOURS = 48
JOBS_PER_MAIL = 10
NO_FILTER_TEXT = "Tất cả việc làm"

VND_RANGES = {
    "under10": (None, 10), "10to20": (10, 20), "20to30": (20, 30),
    "30to50": (30, 50), "over50": (50, None),
}
USD_RANGES = {"usd_under1k": (None, 1000), "usd_1kto2k": (1000, 2000), "usd_over2k": (2000, None)}
CITY_ALIASES = {"hanoi": HANOI, "hochiminh": HCMC, "danang": DANANG}


def _string_member(filters: Column, key: str) -> Column:
    """A member of the filter object when it is JSON text, null for other types."""
    member = F.try_variant_get(F.try_parse_json(filters), f"$.{key}", "variant")
    text = F.try_variant_get(F.try_parse_json(filters), f"$.{key}", "string")
    return F.when(F.schema_of_variant(member) == "STRING", text)


def clean_filters(filters: Column) -> Column:
    """Struct of usable filters; ``all``, empty and unknown values become null."""
    fields = []
    for key, cap in KEY_CAPS.items():
        raw = _string_member(filters, key)
        value = F.nullif(trim_blanks(F.substring(raw, 1, cap)), F.lit(""))
        keep = raw != "all"
        if key == "salary":
            keep = keep & value.isin(*SALARY_CHOICES)
        fields.append(F.when(keep, value).alias(key))
    return F.struct(*fields)


def unsupported_filters(filters: Column) -> Column:
    """Comma-separated names of set filters that postings cannot answer; empty if none."""
    names = []
    for key in UNSUPPORTED_KEYS:
        value = _string_member(filters, key)
        names.append(F.when((trim_blanks(value) != "") & (value != "all"), F.lit(key)))
    return F.concat_ws(",", *names)


def describe_filters(f: Column) -> Column:
    """One-line description of cleaned filters."""
    parts = F.concat_ws(
        " · ",
        f["category"],
        F.when(~f["role"].eqNullSafe(f["category"]), f["role"]),
        f["level"],
        f["experience"],
        f["location"],
        F.when(f["salary"] != "all", f["salary"]),
        F.concat(F.lit('"'), f["keyword"], F.lit('"')),
    )
    return F.coalesce(F.nullif(parts, F.lit("")), F.lit(NO_FILTER_TEXT))


def known_zone(zone: Column) -> Column:
    """Whether Spark knows a time zone by this name."""
    moment = F.concat(F.lit("2000-01-01 00:00:00 "), zone)
    return F.coalesce(F.try_to_timestamp(moment, F.lit("yyyy-MM-dd HH:mm:ss VV")).isNotNull(), F.lit(False))


def local_hour(as_of: Column, zone: Column) -> Column:
    """Hour in the alert's zone, null for an unknown zone; ``as_of`` is a zone-less UTC timestamp."""
    return F.when(known_zone(zone), F.hour(F.convert_timezone(F.lit("UTC"), zone, as_of)))


def is_due(zone: Column, last_sent: Column, as_of: Column) -> Column:
    guard = as_of - F.expr(f"INTERVAL {RESEND_GUARD_HOURS} HOURS")
    here = F.coalesce(local_hour(as_of, zone) == SEND_HOUR, F.lit(False))
    return here & (last_sent.isNull() | (last_sent <= guard))


def past_cooldown(last_sent: Column, created: Column, as_of: Column) -> Column:
    limit = as_of - F.expr(f"INTERVAL {NEW_ALERT_COOLDOWN_HOURS} HOURS")
    return last_sent.isNotNull() | (created <= limit)


def plain_place(c: Column) -> Column:
    """Lower case, ``. _ -`` and runs of blanks read as one space."""
    spaced = F.regexp_replace(F.lower(c), "[._-]+", " ")
    return trim_blanks(F.regexp_replace(spaced, r"\s+", " "))


def any_in(text: Column, needles: tuple[str, ...]) -> Column:
    hit = text.contains(needles[0])
    for needle in needles[1:]:
        hit = hit | text.contains(needle)
    return hit


def classes_of_place(place: Column) -> Column:
    """City classes of a place as ``plain_place`` writes it: ``free``, known cities, ``other`` for none of them. No lambdas; name a column."""
    def some(test: Column, name: str) -> Column:
        return F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    known = [some(any_in(place, names), name) for name, names in CITY_ALIASES.items()]
    return F.concat(F.array(F.lit("free")), *known, some(~any_in(place, HANOI + HCMC + DANANG), "other"))


def place_classes(job_location: Column) -> Column:
    """City classes of a posting: known cities, ``other`` for none of them, and
    ``free`` for any text at all; empty without a location."""
    given = F.coalesce(job_location, F.lit("")) != ""
    return F.when(given, let(plain_place(job_location), classes_of_place)).otherwise(F.array().cast("array<string>"))


def wanted_class(wanted: Column) -> Column:
    """The class a location filter asks for; ``free`` when it names no known city."""
    place = plain_place(wanted)
    kind = F.when(wanted == "other", F.lit("other"))
    for name, aliases in CITY_ALIASES.items():
        kind = kind.when(any_in(place, aliases), F.lit(name))
    return kind.otherwise(F.lit("free"))


def match_location(job_location: Column, wanted: Column) -> Column:
    kind = wanted_class(wanted)
    text = (kind != "free") | plain_place(job_location).contains(plain_place(wanted))
    return F.when(wanted.isNull() | (wanted == "all"), F.lit(True)).otherwise(
        F.coalesce(F.array_contains(place_classes(job_location), kind) & text, F.lit(False))
    )


def is_open_salary(job_salary: Column) -> Column:
    """No salary given, or one that is up for talks."""
    text = F.lower(trim_blanks(job_salary))
    return job_salary.isNull() | (text == "") | text.rlike(r"thỏa\s*thuận|tho\s*thu")


def _in_range(amount: Column, low: int | None, high: int | None) -> Column:
    if low is None:
        return amount < high
    if high is None:
        return amount > low
    return amount.between(low, high)


def choices_of_pay(job_salary: Column, pay: Column) -> Column:
    """Array of the salary choices a posting meets, by its salary and what ``parse_salary`` reads in it. No lambdas; name columns."""
    def some(test: Column, name: str) -> Column:
        return F.when(test, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))

    amount = F.coalesce(pay["min"], pay["value"], pay["max"])
    vnd = [some((pay["currency"] == "VND") & _in_range(amount / 1_000_000, *bounds), name) for name, bounds in VND_RANGES.items()]
    usd = [some((pay["currency"] == "USD") & _in_range(amount, *bounds), name) for name, bounds in USD_RANGES.items()]
    return F.concat(some(is_open_salary(job_salary), "deal"), *vnd, *usd)


def salary_choices(job_salary: Column) -> Column:
    """Array of the salary choices a posting meets, by the lowest amount it names."""
    return let(parse_salary(job_salary), lambda pay: choices_of_pay(job_salary, pay))


def match_salary(job_salary: Column, wanted: Column) -> Column:
    return F.when(wanted.isNull() | (wanted == "all"), F.lit(True)).otherwise(
        F.array_contains(salary_choices(job_salary), wanted)
    )


def match_keyword(title: Column, company: Column, keyword: Column) -> Column:
    word = F.lower(keyword)
    hit = F.lower(F.coalesce(title, F.lit(""))).contains(word) | F.lower(
        F.coalesce(company, F.lit(""))
    ).contains(word)
    return F.when(keyword.isNull(), F.lit(True)).otherwise(hit)


def _same(job_value: Column, wanted: Column) -> Column:
    return F.when(wanted.isNull() | (wanted == "all"), F.lit(True)).otherwise(
        F.coalesce(job_value == wanted, F.lit(False))
    )


def matches(job: dict[str, Column], f: Column) -> Column:
    """Conjunction of every set filter over one posting's columns."""
    return (
        _same(job["category"], f["category"])
        & _same(job["category"], f["role"])
        & match_keyword(job["title"], job["company"], f["keyword"])
        & match_location(job["location"], f["location"])
        & _same(job["experience"], f["experience"])
        & _same(job["level"], f["level"])
        & match_salary(job["salary"], f["salary"])
    )
