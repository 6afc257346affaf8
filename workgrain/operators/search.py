"""Search over postings: filters, pages, vector ranking and skill gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import with_default
from ..functions.location import HANOI, HCMC
from ..functions.skills import extract_skills, skill_gap
from ..functions.text import icontains
from ..functions.vectors import Encoder, cosine_similarity, encode_text, hashing_encoder, unit_rows

PAGE_SIZE = 20
SOURCES = ("all", "topcv", "linkedin", "itviec")
MAX_PAGE = 1_000
MAX_TEXT = 40_000
MAX_FILTER = 120


def check_request(
    cv_text: str = "", word: str = "", place: str = "", origin: str = "", page: int = 1,
    max_text: int = MAX_TEXT, max_filter: int = MAX_FILTER, max_page: int = MAX_PAGE,
) -> None:
    """Limits a service may put on what it is sent; the transforms themselves have none."""
    if max(len(t.strip()) for t in (word, place, origin)) > max_filter:
        raise ValueError("filter text is too long")
    if len(cv_text.strip()) > max_text or not 1 <= page <= max_page:
        raise ValueError("invalid CV text or page")


def keyword(rows: DataFrame, word: str) -> DataFrame:
    return rows.filter(icontains(F.col("title"), word) | icontains(F.col("company"), word))


def location(rows: DataFrame, place: str) -> DataFrame:
    """Hà Nội, Hồ Chí Minh, or (any other value) neither of them; null never matches."""
    def any_of(names: Sequence[str]) -> Column:
        hit = icontains(F.col("location"), names[0])
        for name in names[1:]:
            hit = hit | icontains(F.col("location"), name)
        return hit

    if place == "hà nội":
        return rows.filter(any_of(HANOI))
    if place == "hồ chí minh":
        return rows.filter(any_of(HCMC))
    return rows.filter(~any_of(HANOI + HCMC))


def source(rows: DataFrame, name: str) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}")
    return rows if name == "all" else rows.filter(F.col("source") == name)


def has_url(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("url").isNotNull())


def has_vector(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("embedding").isNotNull())


def recent(rows: DataFrame, cutoff: Column, strict: bool = False) -> DataFrame:
    crawled = F.col("crawled_at")
    return rows.filter(crawled > cutoff if strict else crawled >= cutoff)


def newest_page(rows: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    ordered = rows.orderBy(F.col("crawled_at").desc_nulls_last(), "id")
    return ordered.offset((page - 1) * size).limit(size)


def knn(
    rows: DataFrame, query: Sequence[float], k: int = PAGE_SIZE, offset: int = 0,
    vector: str = "embedding", ident: str = "id",
) -> DataFrame:
    """Exact nearest rows by cosine distance: a scan and a bounded top-k per task.

    Rows without a similarity sort last and drop out after the cut; a filter
    before it would make Spark score every row twice.
    """
    scored = rows.withColumn("similarity", cosine_similarity(F.col(vector), query))
    ranked = scored.orderBy(F.col("similarity").desc_nulls_last(), ident)
    return ranked.offset(offset).limit(k).filter(F.col("similarity").isNotNull())


def filtered(rows: DataFrame, word: str = "", place: str = "", origin: str = "") -> DataFrame:
    """The shared predicate of a result page and its total."""
    word, place, origin = word.strip(), place.strip(), origin.strip()
    rows = has_url(rows)
    if word:
        rows = keyword(rows, word)
    if place and place != "all":
        rows = location(rows, place)
    return source(rows, origin) if origin else rows


def match_total(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def match(
    rows: DataFrame, cv_text: str = "", cv_vector: Sequence[float] | None = None,
    word: str = "", place: str = "", origin: str = "", page: int = 1,
    encoder: Encoder = hashing_encoder,
) -> DataFrame:
    """Result page for a CV: nearest postings with skill gaps; newest ones without a CV.

    Skills are taken from the page's rows only, after the top-k cut.
    """
    cv_text = cv_text.strip()
    if page < 1:
        raise ValueError("pages count from 1")
    rows = filtered(rows, word, place, origin)
    offset = (page - 1) * PAGE_SIZE
    if cv_text or cv_vector is not None:
        if cv_vector is None:
            cv_vector = unit_rows(encoder([cv_text]))[0].tolist()
        found = knn(has_vector(rows), cv_vector, PAGE_SIZE, offset)
    else:
        found = newest_page(rows, page).withColumn("similarity", F.lit(1.0))
    job_text = F.concat_ws(" ", F.coalesce("requirements", F.lit("")), F.coalesce("description", F.lit("")))
    gap = skill_gap(extract_skills(F.lit(cv_text)), extract_skills(job_text))
    return found.withColumn("gap", gap).select(
        "id",
        with_default(F.col("title"), "title").alias("title"),
        with_default(F.col("company"), "company").alias("company"),
        "location", "salary", "experience", "description", "requirements",
        with_default(F.col("url"), "url").alias("url"),
        with_default(F.col("source"), "source").alias("source"),
        "crawled_at", "similarity",
        F.col("gap.matched").alias("matched_skills"),
        F.col("gap.missing").alias("missing_skills"),
        F.col("gap.percentage").alias("match_percentage"),
    )


def missing_vectors(rows: DataFrame, limit: int = 500) -> DataFrame:
    return rows.filter(F.col("embedding").isNull()).orderBy("crawled_at", "id").limit(limit)


def encode(rows: DataFrame, text: Column, encoder: Encoder = hashing_encoder, dimensions: int = 384) -> DataFrame:
    """Fills missing vectors; present ones stay and are not sent to the encoder."""
    present = rows.filter(F.col("embedding").isNotNull())
    absent = rows.filter(F.col("embedding").isNull())
    return present.unionByName(absent.withColumn("embedding", encode_text(text, encoder, dimensions)))


def backfill(
    target: DataFrame, text: Column, limit: int = 500,
    encoder: Encoder = hashing_encoder, dimensions: int = 384,
) -> DataFrame:
    """Encodes the oldest rows without a vector and updates those still null."""
    chosen = missing_vectors(target, limit).select("id", text.alias("_text"))
    made = chosen.select("id", encode_text(F.col("_text"), encoder, dimensions).alias("_made"))
    merged = target.join(made, "id", "left")
    return merged.withColumn("embedding", F.coalesce("embedding", "_made")).drop("_made")


def job_by_id(rows: DataFrame, ident: str) -> DataFrame:
    """Posting by trimmed id with default labels; empty or over-long ids find nothing."""
    ident = ident.strip()
    if not ident or len(ident) > 200:
        return labelled(rows.limit(0))
    return labelled(rows.filter(F.col("id") == ident))


def labelled(rows: DataFrame) -> DataFrame:
    """Serving layout: default labels, columns the canonical table lacks as null."""
    null = F.lit(None).cast("string")
    return rows.select(
        "id",
        with_default(F.col("title"), "title").alias("title"),
        with_default(F.col("company"), "company").alias("company"),
        with_default(F.col("url"), "url").alias("url"),
        "location", "salary", null.alias("logo_url"),
        with_default(F.col("source"), "source").alias("source"),
        null.alias("category"), "experience", null.alias("level"), "description", "requirements",
        F.col("crawled_at").alias("created_at"),
    )


def sitemap_jobs(rows: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Newest first; all of them unless a limit is given."""
    fresh = recent(rows, as_of - F.expr("INTERVAL 30 DAYS"))
    ordered = fresh.select("id", "crawled_at").orderBy(F.desc("crawled_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def digest_candidates(rows: DataFrame, cutoff: Column, limit: int | None = None) -> DataFrame:
    """Oldest first; all of them unless a limit is given."""
    ordered = recent(rows, cutoff, strict=True).select("id", "crawled_at").orderBy("crawled_at", "id")
    return ordered if limit is None else ordered.limit(limit)
