"""Text of the twin queries: shared expressions and common table expressions."""

from __future__ import annotations

from ..functions import salary as pay
from ..functions.skills import ANYWHERE, SKILLS
from ..sources.seeds import CATEGORY_PATTERNS, CITY_PATTERNS
from .fixtures import ALERTS_SQL, AUDIT_SQL, JOBS_SQL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


JOBS = with_(JOBS_SQL)
AUDIT = with_(AUDIT_SQL)
ALERTS = with_(ALERTS_SQL)


def any_in(col: str, *needles: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {q(n.lower())})" for n in needles) + ")"


def case(*arms: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in arms) + f" ELSE {otherwise} END"


def re_(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {q(pattern)})"


def group(col: str, pattern: str, n: int) -> str:
    return f"nullif(regexp_extract({col}, {q(pattern)}, {n}), '')"


def title(col: str) -> str:
    word = r"[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower(trim({col})), '{word}'), "
        "lambda w: upper(w[1]) || w[2:]), '')"
    )


def key(*cols: str) -> str:
    return f"upper(md5({chr(32) + ' || chr(124) || '.join(cols)}))"


CITY_BUCKET = case(
    (any_in("location", "Hà Nội", "Hanoi"), q("Hà Nội")),
    (any_in("location", "Hồ Chí Minh", "Ho Chi Minh", "District 9"), q("Hồ Chí Minh")),
    (any_in("location", "Đà Nẵng", "Da Nang", "Đà Nang"), q("Đà Nẵng")),
    (any_in("location", "Hải Phòng", "Hai Phong"), q("Hải Phòng")),
    (any_in("location", "Cần Thơ", "Can Tho"), q("Cần Thơ")),
    otherwise=q("Khác"),
)
SALARY_TYPE = case(
    (any_in("salary", "Thoả thuận", "Thương lượng"), q("Thoả thuận")),
    (any_in("salary", "Tới", "Up to"), q("Lên đến")),
    (any_in("salary", "Từ"), q("Từ")),
    ("contains(salary, '-')", q("Khoảng")),
    otherwise=q("Khác"),
)
ALL_DIGITS = "coalesce(nullif(regexp_replace(salary, '[^0-9]', '', 'g'), ''), '0')"
EXPERIENCE_LEVEL = case(
    (any_in("experience", "Không yêu cầu", "Dưới 1 năm"), q("Fresher / Junior")),
    (any_in("experience", "1 năm", "2 năm", "3 năm"), q("Mid-level")),
    (any_in("experience", "4 năm", "5 năm"), q("Senior")),
    otherwise=q("Chưa xác định"),
)
CLEAN_SQL = f"""clean AS (SELECT id, title, company, {CITY_BUCKET} AS location_clean,
  location AS location_raw, salary AS raw_salary, {SALARY_TYPE} AS salary_type,
  {ALL_DIGITS} AS salary_numeric_extract, experience AS raw_experience,
  {EXPERIENCE_LEVEL} AS experience_level, source, crawled_at FROM jobs_raw)"""


def education(col: str) -> str:
    return case(
        (any_in(col, "cao đẳng", "college"), q("College")),
        (any_in(col, "đại học", "bachelor"), q("Bachelor")),
        (any_in(col, "thạc sĩ", "master"), q("Master")),
        (any_in(col, "tiến sĩ", "phd"), q("PhD")),
        otherwise=q("Unknown"),
    )


def phrase(col: str) -> str:
    # Cue patterns of experience texts.
    span = r"(?i)((\d+)\s*(-|–|đến|to)\s*(\d+\+?))\s*(năm|years?)"
    plus = r"(?i)((\d+)\s*\+)\s*(năm|years?)"
    below = r"(?i)(dưới|below|less than)\s*(\d+)\s*(năm|years?)"
    least = r"(?i)(tối thiểu|ít nhất|trên|at least|minimum)\s*(\d+)\s*(năm|years?)"
    single = r"(?i)(\d+)\s*(năm|years?)"
    return case(
        (re_(col, span), group(col, span, 1)),
        (re_(col, r"(?i)\d+\s*\+\s*(năm|years|year?)"), group(col, plus, 1)),
        (re_(col, below), group(col, below, 2) + " || '-'"),
        (re_(col, least), group(col, least, 2) + " || '+'"),
        (re_(col, single), group(col, single, 1)),
        otherwise=q("Unknown"),
    )


def years(col: str) -> str:
    p = f"regexp_replace(lower({col}), '[–—]', '-', 'g')"
    first = f"CAST(nullif(regexp_extract({p}, '^([0-9]+)', 1), '') AS DOUBLE)"
    second = f"CAST(nullif(regexp_extract({p}, '-([0-9]+)', 1), '') AS DOUBLE)"
    return case(
        (re_(p, r"^[0-9]+\+?$"), first),
        (re_(p, "^[0-9]+-$"), f"{first} / 2"),
        (re_(p, r"^[0-9]+-[0-9]+\+?$"), f"({first} + {second}) / 2"),
    )


def year_steps(col: str, labels: list[str]) -> str:
    steps = [(f"{col} < {limit}", q(label)) for limit, label in zip((1, 3, 5, 8), labels)]
    return case((f"{col} IS NULL", q("Unknown")), *steps, otherwise=q(labels[-1]))


YEAR_BANDS = ["0-1 year", "1-3 years", "3-5 years", "5-8 years", "8+ years"]
YEAR_RANKS = ["Intern / Fresher", "Junior", "Mid-level", "Senior", "Lead / Principal"]


def _amount(col: str, pattern: str, n: int) -> str:
    return (
        f"TRY_CAST(regexp_extract(lower({col}), {q(pattern)}, {n}) AS BIGINT)"
        f" * CASE WHEN contains(lower({col}), 'usd') THEN 24000 ELSE 1000000 END"
    )


def _bound(col: str, span: str, cue: str, n: int) -> str:
    return case(
        (f"{col} IS NULL OR trim({col}) = ''", "NULL"),
        (f"lower({col}) IN ('thoả thuận', 'thỏa thuận', 'negotiable')", "NULL"),
        (re_(f"lower({col})", r"^\s*\d+\s*-\s*\d+"), _amount(col, span, 1)),
        (re_(f"lower({col})", cue), _amount(col, cue, n)),
    )


def min_salary(col: str) -> str:
    return _bound(col, r"(\d+)\s*-\s*\d+", r"từ\s*(\d+)", 1)


def max_salary(col: str) -> str:
    return _bound(col, r"\d+\s*-\s*(\d+)", r"(upto|tới)\s*(\d+)", 2)


MID_SALARY = (
    "coalesce(round((CAST(salary_min_million AS DOUBLE) + CAST(salary_max_million AS DOUBLE)) / 2, 1), "
    "CAST(salary_min_million AS DOUBLE), CAST(salary_max_million AS DOUBLE))"
)


def band(col: str) -> str:
    arms = [(f"{col} < {top}000000", q(label)) for top, label in pay.BANDS]
    return case((f"{col} IS NULL", q(pay.NO_BAND)), *arms, otherwise=q(pay.TOP_BAND))


def work_model(col: str) -> str:
    low = f"lower(trim({col}))"
    return case(
        (f"{low} IN ('hybrid', 'lai')", q("Hybrid")),
        (f"{low} IN ('remote', 'từ xa')", q("Remote")),
        (f"{low} IN ('at office', 'tại văn phòng', 'on-site', 'on site')", q("On-Site")),
        otherwise=f"trim({col})",
    )


def arrangement(col: str) -> str:
    low = f"lower(trim({col}))"
    return case(
        (f"{low} IN ('toàn thời gian', 'full-time', 'full time', 'fulltime')", q("Full-time")),
        (f"{low} IN ('bán thời gian', 'part-time', 'part time')", q("Part-time")),
        (f"{low} IN ('thực tập', 'internship', 'intern')", q("Internship")),
        otherwise=f"trim({col})",
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in rows)


SEEDS_SQL = (
    f"category_map(pattern, target) AS (VALUES {_values(CATEGORY_PATTERNS)})",
    f"city_map(pattern, city_code, city_en, region) AS (VALUES {_values(CITY_PATTERNS)})",
)
BRONZE_SQL = (
    f"""bronze_topcv AS (SELECT id, {title('title')} AS title, upper(trim(company)) AS company,
  trim(logo_url) AS logo_url, trim(url) AS url, tags AS job_category, {title('location')} AS working_location,
  replace({title('salary')}, ',', '') AS salary, lower(trim(description)) AS descriptions,
  lower(trim(requirements)) AS requirements, lower(trim(experience)) AS experiences,
  {title('requirements')} AS level_of_education, {title('work_arrangement')} AS work_model,
  posted AS posted_to_discord, crawled_at AS created_at FROM jobs_raw WHERE source = 'topcv')""",
    f"""bronze_itviec AS (SELECT id, {title('title')} AS title, upper(trim(company)) AS company,
  trim(logo_url) AS logo_url, trim(url) AS url, tags AS job_category, {title('location')} AS working_location,
  {title('work_model')} AS work_model, {title('tags')} AS tags, lower(trim(description)) AS descriptions,
  lower(trim(concat_ws(' ', requirements, experience))) AS requirements_and_experiences,
  posted AS posted_to_discord, crawled_at AS created_at FROM jobs_raw WHERE source = 'itviec')""",
)
_PLACE = "trim(replace(replace(lower(working_location), '(mới)', ''), '&', '-'))"
BASE_SQL = (
    f"""topcv_base AS (SELECT 'topcv' AS source_platform, url, logo_url, title, company,
  {_PLACE} AS working_location, work_model AS work_arrangement, 'On-Site' AS work_model, salary,
  coalesce(m.target, 'Others') AS job_category, {min_salary('salary')} AS salary_min_million,
  {max_salary('salary')} AS salary_max_million, {education('level_of_education')} AS education_requirement,
  descriptions, requirements, {phrase('experiences')} AS year_of_experiences, b.job_category AS tags,
  posted_to_discord, CAST(created_at AS DATE) AS job_posted_date, created_at AS job_posted_timestamp
  FROM bronze_topcv b LEFT JOIN category_map m ON regexp_matches(lower(b.title), m.pattern))""",
    f"""itviec_base AS (SELECT 'itviec' AS source_platform, url, logo_url, title, company,
  {_PLACE} AS working_location, 'Full-time' AS work_arrangement, work_model, CAST(NULL AS VARCHAR) AS salary,
  coalesce(m.target, 'Others') AS job_category, CAST(NULL AS BIGINT) AS salary_min_million,
  CAST(NULL AS BIGINT) AS salary_max_million,
  {education('requirements_and_experiences')} AS education_requirement, descriptions,
  requirements_and_experiences AS requirements, {phrase('requirements_and_experiences')} AS year_of_experiences,
  tags, posted_to_discord, CAST(created_at AS DATE) AS job_posted_date, created_at AS job_posted_timestamp
  FROM bronze_itviec b LEFT JOIN category_map m ON regexp_matches(lower(b.title), m.pattern))""",
)
LOGOS_SQL = """logos AS (SELECT DISTINCT trim(logo_url) AS logo_url, md5(trim(logo_url)) AS logo_id
  FROM jobs_raw WHERE source = 'topcv' AND logo_url IS NOT NULL)"""
FACT_SQL = (
    """united AS (SELECT * FROM topcv_base UNION ALL SELECT * FROM itviec_base)""",
    """exploded AS (SELECT * EXCLUDE (working_location, place), trim(place) AS working_location
  FROM (SELECT *, unnest(string_split(working_location, '-')) AS place FROM united)
  WHERE NOT contains(place, 'nơi khác'))""",
    f"""measured AS (SELECT e.*, trim(c.city_en) AS job_location, l.logo_id,
  {MID_SALARY} AS salary_avg_million, {years('year_of_experiences')} AS yoe
  FROM exploded e LEFT JOIN city_map c ON regexp_matches(e.working_location, c.pattern)
  LEFT JOIN logos l ON e.logo_url = l.logo_url)""",
    f"""fact AS (SELECT {key('source_platform', 'url')} AS job_id, source_platform, url, logo_id,
  title AS job_title, company AS company_name, job_location, job_category,
  {work_model('work_model')} AS work_model_normalized,
  {arrangement('work_arrangement')} AS work_arrangement_normalized, salary, salary_min_million,
  salary_max_million, salary_avg_million, {band('salary_avg_million')} AS salary_band,
  education_requirement, descriptions, requirements, year_of_experiences AS year_of_experiences_raw,
  yoe AS year_of_experiences_normalized, {year_steps('yoe', YEAR_BANDS)} AS year_of_experiences,
  {year_steps('yoe', YEAR_RANKS)} AS experiences_level, tags, posted_to_discord, job_posted_date,
  job_posted_timestamp FROM measured)""",
)
CLASSIFIED_SQL = "classified AS (SELECT * FROM fact WHERE job_category <> 'Others')"
FACT_CTES = (JOBS_SQL, *SEEDS_SQL, *BRONZE_SQL, *BASE_SQL, LOGOS_SQL, *FACT_SQL, CLASSIFIED_SQL)
FACT = with_(*FACT_CTES)


# Serving salary grammar.
def pay_ctes(source: str, col: str = "salary") -> tuple[str, str]:
    """CTE ``paid``: the rows of ``source`` with pay_currency, pay_min, pay_max, pay_value."""
    s = f"lower(trim({col}))"
    number = (
        "CASE WHEN regexp_matches(t, '^\\d+[.,]\\d{0,2}$') THEN TRY_CAST(regexp_replace(t, '[.,]', '.') AS DOUBLE)"
        " ELSE TRY_CAST(regexp_replace(t, '[.,]', '', 'g') AS DOUBLE) END"
    )
    scale = f"CASE WHEN NOT {re_(s, pay.USD)} AND {re_(s, pay.VND_MILLIONS)} THEN 1000000 ELSE 1 END"
    known = f"regexp_matches({s}, 'usd|\\$|tri[eệ]u|vnd|vnđ|đ[oồ]ng|\\bdong\\b|₫')"
    amounts = (
        f"""paid_nums AS (SELECT *, CASE WHEN {known} THEN list_filter(list_transform(
  regexp_extract_all({s}, '\\d[\\d.,]*'), lambda t: round(({number}) * {scale})),
  lambda n: n IS NOT NULL AND n > 0) END AS nums,
  CASE WHEN {re_(s, pay.USD)} THEN 'USD' ELSE 'VND' END AS cur,
  regexp_matches({s}, 't[ớơ]i|đ[eế]n|under|up to|tối đa') AS up_cue,
  regexp_matches({s}, 't[ừu]\\s|\\bfrom\\b|tr[eê]n|tối thiểu|starting') AS low_cue FROM {source})"""
    )
    paid = """paid AS (SELECT *, CASE WHEN len(nums) > 0 THEN cur END AS pay_currency,
  CASE WHEN len(nums) >= 2 THEN list_min(nums) WHEN len(nums) = 1 AND NOT up_cue AND low_cue THEN nums[1] END AS pay_min,
  CASE WHEN len(nums) >= 2 THEN list_max(nums) WHEN len(nums) = 1 AND up_cue THEN nums[1] END AS pay_max,
  CASE WHEN len(nums) = 1 AND NOT up_cue AND NOT low_cue THEN nums[1] END AS pay_value FROM paid_nums)"""
    return amounts, paid


def skills(col: str) -> str:
    """Comma-separated skills of a text, in list order."""
    arms = []
    for skill in SKILLS:
        if skill in ANYWHERE:
            test = f"contains({col}, {q(skill)})"
        else:
            test = f"regexp_matches({col}, {q(chr(92) + 'b' + skill + chr(92) + 'b')})"
        arms.append(f"CASE WHEN {test} THEN {q(skill)} END")
    return f"list_filter([{', '.join(arms)}], lambda s: s IS NOT NULL)"


SLUG = (
    "regexp_replace(regexp_replace(replace(strip_accents(lower(company)), 'đ', 'd'), "
    "'[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
)
