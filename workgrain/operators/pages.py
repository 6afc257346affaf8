"""Page extraction: one Arrow-batched pass over pages, then Column expressions.

The pass turns a page into plain values (texts by name, lists, label/value
sections, heading/text blocks); lookups, fallbacks and clean-up stay in Spark.
What to read is configuration, so one operator serves every source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import Hit, Matches, Selectors, clean_html, read, select, tree
from ..functions.text import cut_at, last_segment, trim_blanks
from ..session import scratch_dir
from .state import dedup

Pairs = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Spec:
    """Selectors of one page layout.

    ``texts``: name → selectors in order of preference, the first with text wins.
    ``attrs``: name → (selector, attribute). ``lists``: name → selector of items.
    ``sections`` and ``blocks``: a row selector and (key, value) selector pairs.
    ``card``: when set, every match gives a row of its own and is its own root.
    ``container``: the first that exists is where sections are looked for.
    """

    texts: dict[str, Sequence[str]] = field(default_factory=dict)
    attrs: dict[str, tuple[str, str]] = field(default_factory=dict)
    lists: dict[str, str] = field(default_factory=dict)
    sections: tuple[str, Pairs] | None = None
    blocks: tuple[str, Pairs] | None = None
    card: str | None = None
    container: Sequence[str] = ()


PARSED = (
    "card int, texts map<string,string>, lists map<string,array<string>>, "
    "sections array<struct<label:string,value:string,row:string>>, "
    "blocks array<struct<heading:string,text:string,items:array<string>>>, parse_error string"
)


PARSED_ARROW = (
    ("card", pa.int32()), ("texts", pa.map_(pa.string(), pa.string())), ("lists", pa.map_(pa.string(), pa.list_(pa.string()))),
    ("sections", pa.list_(pa.struct([(n, pa.string()) for n in ("label", "value", "row")]))),
    ("blocks", pa.list_(pa.struct([("heading", pa.string()), ("text", pa.string()), ("items", pa.list_(pa.string()))]))),
    ("parse_error", pa.string()),
)
ROWS_CHARS = 1 << 20  # characters of the pages whose rows are put into one batch
ITEMS = "div, li"


def _selectors(spec: Spec) -> list[str]:
    """Every selector of a layout."""
    named = [*(s for chosen in spec.texts.values() for s in chosen), *(s for s, _ in spec.attrs.values()), *spec.lists.values()]
    for part in (spec.sections, spec.blocks):
        if part:
            named += [part[0], *(s for pair in part[1] for s in pair if s)]
    return [*named, *spec.container, *([spec.card] if spec.card else []), *([ITEMS] if spec.blocks else [])]


def _first_text(found: Matches, root: Hit, selectors: Sequence[str]) -> str:
    for selector in selectors:
        node = found.first(root, selector)
        if node is not None:
            text = node.attrs.get("content", "") if node.tag == "meta" else node.text()
            if text:
                return text
    return ""


def _pair(found: Matches, row: Hit, pairs: Pairs) -> tuple[Hit | None, Hit | None]:
    """Key and value of a row by the first pair whose key is there."""
    for key, value in pairs:
        node = found.first(row, key)
        if node is not None:
            return node, found.first(row, value) if value else None
    return None, None


def _read(found: Matches, root: Hit, spec: Spec) -> tuple[dict, dict, list, list]:
    texts = {name: _first_text(found, root, selectors) for name, selectors in spec.texts.items()}
    for name, (selector, attr) in spec.attrs.items():
        node = found.first(root, selector)
        texts[name] = node.attrs.get(attr, "") if node is not None else ""
    lists = {name: [n.text() for n in found.below(root, sel)] for name, sel in spec.lists.items()}
    sections, blocks = [], []
    if spec.sections:
        place = next((n for s in spec.container if (n := found.first(root, s)) is not None), root)
        for row in found.below(place, spec.sections[0]):
            key, value = _pair(found, row, spec.sections[1])
            sections.append((key.text() if key else None, value.text() if value else None, row.text()))
    if spec.blocks:
        for row in found.below(root, spec.blocks[0]):
            key, value = _pair(found, row, spec.blocks[1])
            if value is not None:
                items = [n.text() for n in found.below(value, ITEMS)]
                blocks.append((key.text(), value.text(), items))
    return texts, lists, sections, blocks


def parse(pages: DataFrame, spec: Spec | dict[str, Spec], html: str = "html", layout: str | None = None) -> DataFrame:
    """Adds the parsed values to each page; a page that cannot be read gets a
    ``parse_error`` and no values, and the others go on.

    Each page is walked once, whatever the number of selectors. With several layouts the column ``layout`` names each
    page's; a page whose layout is null or not among them is not read and has neither values nor an error.
    """
    kept = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    specs = spec if isinstance(spec, dict) else {"": spec}

    def rows_of(page: str | None, name: str | None, known: dict[str, Selectors]) -> list[tuple]:
        if name not in known:
            return [(0, None, None, None, None, None)]
        try:
            if not page:
                raise ValueError("empty page")
            one = specs[name]
            root, found = read(page, known[name])
            roots = found.below(root, one.card) if one.card else [root]
            return [(i, *_read(found, r, one), None) for i, r in enumerate(roots)]
        except Exception as error:  # noqa: BLE001 - reported in the row, the batch goes on
            return [(0, None, None, None, None, f"{type(error).__name__}: {error}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {name: Selectors(_selectors(one)) for name, one in specs.items()}
        for batch in batches:
            texts, which = batch.column(html), batch.column(layout) if layout else None
            places, values, room = [], [], ROWS_CHARS
            for place in range(batch.num_rows):
                page = texts[place].as_py()
                rows = rows_of(page, which[place].as_py() if layout else "", known)
                places += [place] * len(rows)
                values += rows
                room -= len(page or "") + 256
                if room < 0:
                    yield _parsed(batch, kept, places, values)
                    places, values, room = [], [], ROWS_CHARS
            if places:
                yield _parsed(batch, kept, places, values)

    return pages.mapInArrow(run, f"{schema}, {PARSED}" if kept else PARSED)


def _parsed(batch: pa.RecordBatch, kept: Sequence[str], places: list[int], values: list[tuple]) -> pa.RecordBatch:
    chosen = pa.array(places, pa.int64())
    columns = {c: batch.column(c).take(chosen) for c in kept}
    for (name, kind), value in zip(PARSED_ARROW, zip(*values, strict=True), strict=True):
        maps = pa.types.is_map(kind)
        columns[name] = pa.array([v if v is None else list(v.items()) for v in value] if maps else value, kind)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def split_errors(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable pages, and the reported ones. The parsed pages are stored first, so that both are read from one run."""
    path = scratch_dir(parsed.sparkSession, "parsed-pages")
    parsed.write.parquet(path)
    stored = parsed.sparkSession.read.schema(parsed.schema).parquet(path)
    return stored.filter(F.col("parse_error").isNull()), stored.filter(F.col("parse_error").isNotNull())


def text(name: str) -> Column:
    return F.coalesce(F.element_at("texts", F.lit(name)), F.lit(""))


def info(label: str) -> Column:
    """Value of the first section with this label in any case; the whole section
    when it has no value part; empty text without such a section."""
    hits = F.filter("sections", lambda s: F.lower(s["label"]) == label.lower())
    first = F.get(hits, F.lit(0))
    return F.coalesce(first["value"], first["row"], F.lit(""))


def block(heading: str, last: bool = True) -> Column:
    """Text under a heading; of several such headings the last one counts."""
    hits = F.filter("blocks", lambda b: b["heading"] == heading)
    chosen = F.get(hits, F.size(hits) - 1 if last else F.lit(0))
    return F.coalesce(chosen["text"], F.lit(""))


def block_items(heading: str, separator: str) -> Column:
    """Filled items of every block whose heading holds the words, joined."""
    hits = F.filter("blocks", lambda b: b["heading"].contains(heading))
    items = F.flatten(F.transform(hits, lambda b: b["items"]))
    return F.array_join(F.filter(items, lambda i: i != ""), separator)


def block_map() -> Column:
    """All blocks as a map; duplicate headings keep the last text."""
    def is_last(b: Column, i: Column) -> Column:
        later = F.slice("blocks", i + 2, F.size("blocks"))
        return ~F.exists(later, lambda o: o["heading"].eqNullSafe(b["heading"]))

    kept = F.transform(F.filter("blocks", is_last), lambda b: F.struct(b["heading"], b["text"]))
    return F.map_from_entries(kept)


def joined(name: str, separator: str) -> Column:
    """Items of a list in page order, empty ones left out."""
    items = F.coalesce(F.element_at("lists", F.lit(name)), F.array().cast("array<string>"))
    return F.array_join(F.filter(items, lambda i: i != ""), separator)


def deadline(c: Column) -> Column:
    """First d/m/yyyy of a deadline text, otherwise the text."""
    date = r"(\d{1,2}/\d{1,2}/\d{4})"
    return F.when(c.rlike(date), F.regexp_extract(c, date, 1)).otherwise(c)


def require(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose named fields are all filled."""
    for name in columns:
        rows = rows.filter(F.coalesce(F.col(name), F.lit("")) != "")
    return rows


def deadline_line() -> Column:
    """The first deadline element that names the deadline; null without one."""
    named = F.filter(F.element_at("lists", F.lit("deadline")), lambda t: t.contains(DEADLINE_WORDS))
    return F.get(named, F.lit(0))


def absolute(link: Column, base: str) -> Column:
    """A link resolved against a site's root; empty and null links are null."""
    return (
        F.when(F.coalesce(link, F.lit("")) == "", None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lit(base.split("//")[0]), link))
        .when(link.startswith("/"), F.concat(F.lit(base), link))
        .otherwise(F.concat(F.lit(f"{base}/"), link))
    )


# ---- layouts ----

# Site roots, the words of a deadline, page selectors, url forms and output columns.
TOPCV_ROOT = "https://www.topcv.vn"
DEADLINE_WORDS = "Hạn nộp"

_INFO = (
    ".job-detail__info--section",
    ((".job-detail__info--section-content-title", ".job-detail__info--section-content-value"),),
)
_BLOCKS = (
    ".job-description .job-description__item", (("h3", ".job-description__item--content"),)
)
TOPCV_DETAIL = Spec(
    texts={
        "title": (".job-detail__info--title, h1",),
        "company": ("a.company-name", "h2.company-name"),
    },
    attrs={"company_url": ("a.company[href], a[href*='/cong-ty/']", "href")},
    lists={
        "tags": ".job-tags a.item",
        "deadline": ".job-detail__info--deadline, .job-detail__information-detail--actions-label",
    },
    sections=_INFO,
    blocks=_BLOCKS,
)
ITVIEC_DETAIL = Spec(
    texts={
        "title": ("h1",),
        "company": (".employer-info__name, .company-name, h3.name",),
        "location": (".location, .svg-icon__box",),
        "salary": (".salary-text, .salary, .svg-icon__box-salary",),
        "description": (".job-description, .description",),
        "requirements": (".job-requirements, .requirements, .skills-requirements",),
    },
    lists={"tags": ".job-tags .tag, .skill-tag"},
)
LINKEDIN_DETAIL = Spec(
    texts={
        "title": ("h1.top-card-layout__title",),
        "company": ("a.topcard__org-name-link",),
        "location": ("span.topcard__flavor--bullet",),
        "description": ("div.description__text, div.show-more-less-html__markup",),
    },
)
LINK_SELECTORS = {
    "topcv": "div.job-item-search-result h3.title a[href]",
    "itviec": "h3 a[href*='/it-jobs/']",
    "linkedin": "a.base-card__full-link",
}
TOPCV_CARDS = Spec(
    card="div.job-item-search-result",
    texts={
        "title": ("h3.title a[href]",),
        "company": ("a.company .company-name",),
        "salary_list": ("label.title-salary",),
        "address_list": ("label.address .city-text",),
        "exp_list": ("label.exp span",),
    },
    attrs={"job_url": ("h3.title a[href]", "href"), "company_url": ("a.company[href]", "href")},
)
ITVIEC_CARDS = Spec(
    card="div.job-card",
    texts={
        "title": ("h3",),
        "company": ("div.imy-3 span",),
        "mode": ("div.text-rich-grey.flex-shrink-0",),
    },
    attrs={
        "url": ("h3.text-break", "data-url"),
        "logo": ("div.imy-3 img", "data-src"),
        "location": ("div.text-rich-grey.text-truncate", "title"),
    },
    lists={"tags": "div.imt-4.igap-1 a"},
)
BRAND_DETAIL = Spec(
    sections=("div.general-information-data, div.box-item", (
        (".general-information-data__label", ".general-information-data__value"),
        ("strong", "span"),
    )),
    blocks=("div.premium-job-description__box, div.box-info", (
        ("h2.premium-job-description__box--title", "div.premium-job-description__box--content"),
        ("h2.title", "div.content-tab"),
    )),
)
STANDARD_DETAIL = Spec(
    sections=("div.box-general-group-info", (
        ("div.box-general-group-info-title", "div.box-general-group-info-value"),
    )),
    blocks=("div.job-description__item", (("h3", "div.job-description__item--content"),)),
)
COMPANY_PROFILE = Spec(
    texts={
        "name": (
            "h1.company-name", "h1.title", "div.company-header h1", "div.company-info h1",
            "meta[property='og:title']", "meta[property='og:site_name']", "title",
        ),
        "description": (
            "div.company-description", "div#company-description", "div.box-intro-company",
            "div.company-introduction", "div.description", "section.company-description",
            "div#readmore-company", "div#readmore-content",
        ),
    },
    sections=("li, .row, .item, .info-item, .company-info-item, .dl, .d-flex", (("strong, b", ""),)),
    container=(
        "div.company-overview", "div.company-detail", "div.company-profile", "section#company",
        "section.company-info", "div.box-intro-company", "div.company-info-container",
    ),
)
URL_FORMS = {
    "topcv": ("", "https://www.topcv.vn/viec-lam/", ".html"),
    "itviec": ("itviec_", "https://itviec.com/it-jobs/", ""),
    "linkedin": ("linkedin_", "https://www.linkedin.com/jobs/view/", ""),
}


# ---- operators ----


def discover_links(
    pages: DataFrame, selector: str, base: str, hosts: tuple[str, str] | None = None,
    html: str = "html", errors: bool = False,
) -> DataFrame:
    """Distinct absolute links without query, with a country host replaced.

    A page that is empty or cannot be read gives no link; with ``errors`` such pages
    are reported in a column ``parse_error`` beside rows of links.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch[html]:
                try:
                    if not page:
                        raise ValueError("empty page")
                    nodes = select(tree(page), selector)
                    rows += [(urljoin(base, n.attrs["href"]), None) for n in nodes if n.attrs.get("href")]
                except Exception as error:  # noqa: BLE001 - reported in a row, the batch goes on
                    rows.append((None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["url", "parse_error"], dtype=object)

    found = pages.select(html).mapInPandas(run, "url string, parse_error string")
    url = cut_at(F.col("url"), "?")
    if hosts:
        url = F.replace(url, F.lit(hosts[0]), F.lit(hosts[1]))
    links = found.select(url.alias("url"), "parse_error")
    return links.distinct() if errors else links.filter("url IS NOT NULL").select("url").distinct()


def extract_records(pages: DataFrame, source: str, crawled_at: Column, ident: str = "page_id") -> DataFrame:
    """Canonical rows of one source's detail pages, with a ``parse_error`` column."""
    spec = {"topcv": TOPCV_DETAIL, "itviec": ITVIEC_DETAIL, "linkedin": LINKEDIN_DETAIL}[source]
    fields = {name: text(name) for name in ("title", "company", "location", "salary", "description", "requirements")}
    experience = F.lit("")
    if source == "topcv":
        fields |= {
            "location": info("Địa điểm"), "salary": info("Mức lương"),
            "description": block("Mô tả công việc"), "requirements": block("Yêu cầu ứng viên"),
        }
        experience = info("Kinh nghiệm")
    prefix, start, end = URL_FORMS[source]
    key = F.col(ident).cast("string")
    url = F.concat(F.lit(start), F.replace(key, F.lit(prefix), F.lit("")) if prefix else key, F.lit(end))
    return parse(pages.select(ident, "html"), spec).select(
        key.alias("id"),
        *[c.alias(name) for name, c in fields.items()],
        experience.alias("experience"),
        joined("tags", ", ").alias("tags"),
        F.lit(source).alias("source"), url.alias("url"), crawled_at.alias("crawled_at"),
        "parse_error",
    )


def extract_cards(
    pages: DataFrame, spec: Spec, base: str = TOPCV_ROOT, links: Sequence[str] = ("job_url", "company_url"),
    required: str = "job_url", cut: str | None = None, errors: bool = False,
) -> DataFrame:
    """One row per list card, columns named as in the layout.

    ``links`` are made absolute (and lose what follows ``cut``); a card without the
    ``required`` link is no posting and is left out. With ``errors`` a page that
    cannot be read is a row with its ``parse_error``.
    """
    names = [*spec.texts, *spec.attrs]
    values = {n: F.nullif(text(n), F.lit("")) for n in names}
    values |= {n: F.nullif(joined(n, ", "), F.lit("")) for n in spec.lists}
    for name in links:
        if name in values:
            link = absolute(values[name], base)
            values[name] = cut_at(link, cut) if cut else link
    kept = [c for c in pages.columns if c != "html"]
    cards = parse(pages, spec).select(*kept, "card", *[c.alias(n) for n, c in values.items()], "parse_error")
    good = F.col("parse_error").isNull() & (F.col(required).isNotNull() if required in values else F.lit(True))
    return cards.filter(good | F.col("parse_error").isNotNull()) if errors else cards.filter(good).drop("parse_error")


def extract_by_template(pages: DataFrame, url: str = "url") -> DataFrame:
    """Description, requirements, education and work type by the page's template;
    pages of neither template get nulls. One pass reads the pages of both."""
    template = F.when(F.col(url).contains("/brand/"), F.lit("brand")).when(F.col(url).contains("/viec-lam/"), F.lit("standard"))
    kept = [c for c in pages.columns if c != "html"]
    values = {
        "descriptions": block("Mô tả công việc", last=False),
        "requirements": block("Yêu cầu ứng viên", last=False),
        "education": info("Học vấn"),
        "type_of_work": info("Hình thức làm việc"),
    }
    layouts = {"brand": BRAND_DETAIL, "standard": STANDARD_DETAIL}
    parsed = parse(pages.withColumn("_template", template), layouts, layout="_template")
    return parsed.select(*kept, *[F.nullif(c, F.lit("")).alias(name) for name, c in values.items()], "parse_error")


# Label words of the profile facts.
PROFILE_LABELS = {
    "company_website": ("website", "trang web"),
    "company_size": ("quy mô", "size", "nhân sự"),
    "company_industry": ("lĩnh vực", "industry", "ngành"),
    "company_address": ("địa chỉ", "address"),
}
_COLON = r"^([^:：]+)[:：]\s*(.+)$"
_EDGES = " :-–—"


def extract_company(pages: DataFrame) -> DataFrame:
    """Company facts from labelled rows; of several rows with a label the last counts."""

    def fact(s: Column) -> Column:
        marked = s["label"].isNotNull()
        literal = F.concat(F.lit(r"(?iu)\Q"), s["label"], F.lit(r"\E"))
        rest = F.when(s["label"] != "", F.regexp_replace(s["row"], literal, F.lit("")))
        label = F.when(marked, s["label"]).otherwise(F.regexp_extract(s["row"], _COLON, 1))
        value = F.when(marked, F.btrim(F.coalesce(rest, s["row"]), F.lit(_EDGES))).otherwise(
            F.regexp_extract(s["row"], _COLON, 2)
        )
        return F.struct(F.lower(trim_blanks(label)).alias("label"), trim_blanks(value).alias("value"))

    def kind(label: Column) -> Column:
        result = F.when(F.lit(False), F.lit(""))
        for name, words in PROFILE_LABELS.items():
            test = label.contains(words[0])
            for word in words[1:]:
                test = test | label.contains(word)
            result = result.when(test, F.lit(name))
        return result

    facts = F.filter(F.transform("sections", fact), lambda f: (f["label"] != "") & (f["value"] != ""))
    kinds = F.transform(facts, lambda f: F.struct(kind(f["label"]).alias("kind"), f["value"].alias("value")))
    kept = [c for c in pages.columns if c != "html"]
    parsed = parse(pages, COMPANY_PROFILE).withColumn("facts", kinds)

    def newest(name: str) -> Column:
        hits = F.filter("facts", lambda f: f["kind"] == name)
        return F.get(hits, F.size(hits) - 1)["value"].alias(name)

    return parsed.select(
        *kept,
        F.nullif(F.regexp_replace(text("name"), r"(?i)\s*\|\s*TopCV.*$", ""), F.lit("")).alias("company_name_full"),
        *[newest(name) for name in PROFILE_LABELS],
        F.nullif(text("description"), F.lit("")).alias("company_description"),
        "parse_error",
    )


ASSEMBLED = (
    "title", "detail_title", "job_url", "company", "company_name_full", "company_url",
    "company_url_from_job", "salary_list", "detail_salary", "address_list", "detail_location",
    "exp_list", "detail_experience", "deadline", "tags", "working_addresses", "working_times",
    "desc_mota", "desc_yeucau", "desc_quyenloi", "company_website", "company_size",
    "company_industry", "company_address", "company_description",
)


def extract_details(pages: DataFrame) -> DataFrame:
    """Detail part of the assembled rows, one per page url."""
    place = ("Địa điểm làm việc", "Thời gian làm việc")
    blank = F.lit("")
    values = {
        "detail_title": text("title"), "detail_salary": info("Mức lương"),
        "detail_location": info("Địa điểm"), "detail_experience": info("Kinh nghiệm"),
        "deadline": deadline(deadline_line()),
        "tags": joined("tags", "; "),
        "working_addresses": block_items(place[0], "; "),
        "working_times": block_items(place[1], "; "),
        "desc_mota": block("Mô tả công việc"), "desc_yeucau": block("Yêu cầu ứng viên"),
        "desc_quyenloi": block("Quyền lợi"), "company_url_from_job": absolute(text("company_url"), TOPCV_ROOT),
    }
    parsed = parse(pages.select("url", "html"), TOPCV_DETAIL)
    return parsed.select("url", *[F.nullif(c, blank).alias(n) for n, c in values.items()], "parse_error")


def assemble(cards: DataFrame, details: DataFrame, companies: DataFrame) -> DataFrame:
    """Cards ⋈ details ⋈ companies in the fixed column order: the first card of every
    url path, the company link of the detail page before that of the card."""
    path = F.regexp_replace(cut_at(F.col("job_url"), "?"), "^https?://[^/]+", "")
    first = dedup(cards.withColumn("_path", path), "_path", ["page_id", "card"])
    with_detail = first.join(details.drop("parse_error").withColumnRenamed("url", "job_url"), "job_url", "left")
    link = F.coalesce("company_url_from_job", "company_url")
    profiles = companies.drop("parse_error").withColumnRenamed("url", "_link")
    linked = with_detail.withColumn("_link", link).join(profiles, "_link", "left")
    return linked.select(*ASSEMBLED)


def sanitize_html(rows: DataFrame, column: str) -> DataFrame:
    """Cleans the markup of one column; the page helper runs on Arrow batches.

    Markup that cannot be read becomes null with its ``parse_error`` (such a column is replaced).
    """

    markup = pa.struct([("markup", pa.string()), ("parse_error", pa.string())])

    def clean_one(value: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if value is None else clean_html(value), None)
        except Exception as error:  # noqa: BLE001 - reported in the row, the batch goes on
            return (None, f"{type(error).__name__}: {error}")

    @F.arrow_udf("markup string, parse_error string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            done, room = [], ROWS_CHARS
            for value in values:  # one page at a time is a string, what is cleaned leaves before the batch is through
                page = value.as_py()
                done.append(clean_one(page))
                room -= len(page or "") + 256
                if room < 0:
                    yield pa.array(done, markup)
                    done, room = [], ROWS_CHARS
            if done:
                yield pa.array(done, markup)
            del values, done  # so that they are not kept while the next batch is read

    cleaned = rows.withColumn("__clean", clean(F.col(column)))
    return cleaned.withColumns({column: F.col("__clean.markup"), "parse_error": F.col("__clean.parse_error")}).drop("__clean")


def page_id(path: Column) -> Column:
    return last_segment(path)
