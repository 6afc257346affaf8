"""Salary text grammars: the serving form (struct) and the warehouse form (columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, let, trim_blanks

# Exchange rates of the warehouse and of the dashboard.
WAREHOUSE_RATE = 24_000
DASHBOARD_RATE = 25_000
MILLION = 1_000_000

# Spellings of "negotiable" that carry no number.
NEGOTIABLE = ("thoả thuận", "thỏa thuận", "negotiable")

# Cue patterns of the serving grammar, applied to lower-case text.
USD = r"usd|\$"
VND_MILLIONS = "tri[eệ]u"
VND = r"vnd|vnđ|đ[oồ]ng|(?<![A-Za-z0-9_])dong(?![A-Za-z0-9_])|₫"
UPPER_CUE = "t[ớơ]i|đ[eế]n|under|up to|tối đa"
LOWER_CUE = r"t[ừu]\s|(?<![A-Za-z0-9_])from(?![A-Za-z0-9_])|tr[eê]n|tối thiểu|starting"

# Upper limits and labels of the salary bands.
BANDS = [(10, "Below 10M VND")] + [
    (top, f"{top - 10}-{top}M VND") for top in range(20, 101, 10)
]
TOP_BAND = "Above 100M VND"
NO_BAND = "Not Specified"


def localized_number(token: Column) -> Column:
    """``1.000`` and ``1,000`` are grouped, ``1,5`` is a decimal; null unless above zero."""
    value = F.when(
        token.rlike(r"^\d+[.,]\d{0,2}$"), F.regexp_replace(token, "[.,]", ".")
    ).otherwise(F.regexp_replace(token, "[.,]", ""))
    number = value.try_cast("double")
    return F.when(number > 0, number)


def parse_salary(c: Column) -> Column:
    """Struct (currency, min, max, value); null when no currency or number is named."""
    s = F.lower(trim_blanks(c))
    usd, millions = s.rlike(USD), s.rlike(VND_MILLIONS)
    known = usd | millions | s.rlike(VND)
    scale = F.when(~usd & millions, F.lit(float(MILLION))).otherwise(F.lit(1.0))
    tokens = F.regexp_extract_all(s, F.lit(r"(\d[\d.,]*)"), F.lit(1))
    amounts = F.filter(
        F.transform(tokens, lambda t: F.round(localized_number(t) * scale)),
        lambda n: n.isNotNull(),
    )
    upper, lower = s.rlike(UPPER_CUE), s.rlike(LOWER_CUE)

    def pay(found: Column) -> Column:
        several, single = F.size(found) >= 2, F.get(found, F.lit(0))
        return F.struct(
            F.when(usd, F.lit("USD")).otherwise(F.lit("VND")).alias("currency"),
            F.when(several, F.array_min(found)).when(~upper & lower, single).alias("min"),
            F.when(several, F.array_max(found)).when(upper, single).alias("max"),
            F.when(~several & ~upper & ~lower, single).alias("value"),
        )

    return F.when(known, let(amounts, lambda found: F.when(F.size(found) > 0, pay(found))))


def _digits(c: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("bigint")


def _scaled(number: Column, low: Column) -> Column:
    return number * F.when(low.contains("usd"), F.lit(WAREHOUSE_RATE)).otherwise(F.lit(MILLION))


def _no_amount(c: Column, low: Column) -> Column:
    return c.isNull() | (trim_blanks(c) == "") | low.isin(*NEGOTIABLE)


def min_salary(c: Column) -> Column:
    """Lower bound in VND of ``a - b`` or ``từ a``."""
    low = F.lower(c)
    return (
        F.when(_no_amount(c, low), F.lit(None).cast("bigint"))
        .when(low.rlike(r"^\s*\d+\s*-\s*\d+"), _scaled(_digits(low, r"(\d+)\s*-\s*\d+", 1), low))
        .when(low.rlike(r"từ\s*\d+"), _scaled(_digits(low, r"từ\s*(\d+)", 1), low))
    )


def max_salary(c: Column) -> Column:
    """Upper bound in VND of ``a - b``, ``tới b`` or ``upto b``."""
    low = F.lower(c)
    return (
        F.when(_no_amount(c, low), F.lit(None).cast("bigint"))
        .when(low.rlike(r"^\s*\d+\s*-\s*\d+"), _scaled(_digits(low, r"\d+\s*-\s*(\d+)", 1), low))
        .when(low.rlike(r"(upto|tới)\s*\d+"), _scaled(_digits(low, r"(upto|tới)\s*(\d+)", 2), low))
    )


def mid_salary(low: Column, high: Column) -> Column:
    """Midpoint of the two bounds, or the one that is there."""
    return F.coalesce(
        F.round((low.cast("double") + high.cast("double")) / 2, 1),
        low.cast("double"),
        high.cast("double"),
    )


def salary_band(c: Column) -> Column:
    """Band of an amount; the amount is read once, so it is computed once."""
    labels = F.array(*[F.lit(label) for _, label in BANDS], F.lit(TOP_BAND))
    step = F.width_bucket(c, F.lit(0.0), F.lit(100.0 * MILLION), F.lit(len(BANDS)))
    return F.coalesce(F.get(labels, (step - 1).cast("int")), F.lit(NO_BAND))


def salary_range_text(low: Column, high: Column) -> Column:
    """``a-bM VND``; a missing side lies ten million away from the other.

    The upper bound of a range with a missing lower bound is printed unscaled,
    as the rule this follows does.
    """
    def whole(c: Column) -> Column:
        return F.floor(c / MILLION).cast("string")

    step = 10 * MILLION
    only_high = F.when(high - step < 0, F.lit("0")).otherwise(whole(high - step))
    return (
        F.when(low.isNull() & high.isNull(), F.lit(NO_BAND))
        .when(low.isNull(), F.concat(only_high, F.lit("-"), high.cast("string"), F.lit("M VND")))
        .when(high.isNull(), F.concat(whole(low), F.lit("-"), whole(low + step), F.lit("M VND")))
        .otherwise(F.concat(whole(low), F.lit("-"), whole(high), F.lit("M VND")))
    )


def salary_type(c: Column) -> Column:
    return (
        F.when(contains_any(c, "Thoả thuận", "Thương lượng"), F.lit("Thoả thuận"))
        .when(contains_any(c, "Tới", "Up to"), F.lit("Lên đến"))
        .when(contains_any(c, "Từ"), F.lit("Từ"))
        .when(c.contains("-"), F.lit("Khoảng"))
        .otherwise(F.lit("Khác"))
    )


def all_digits(c: Column) -> Column:
    """Every digit of the text run together (``10 - 20`` gives 1020); 0 without digits."""
    digits = F.regexp_replace(c, "[^0-9]", "")
    return F.coalesce(F.nullif(digits, F.lit("")), F.lit("0")).try_cast("decimal(38,0)")


def vnd_millions_mean(c: Column, rate: int = DASHBOARD_RATE) -> Column:
    """Mean of the parsed bounds in VND millions."""
    def mean(parsed: Column) -> Column:
        fallback = F.coalesce(parsed["value"], parsed["min"], parsed["max"])
        low = F.coalesce(parsed["min"], fallback)
        high = F.coalesce(parsed["max"], fallback)
        unit = F.when(parsed["currency"] == "USD", F.lit(float(rate))).otherwise(F.lit(1.0))
        return (low * unit / MILLION + high * unit / MILLION) / 2

    return let(parse_salary(c), mean)
