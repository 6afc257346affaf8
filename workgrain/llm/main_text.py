"""Main text of web pages: long runs of tokens that pages of a host repeat are its boilerplate.

The token streams of a host's pages (all words and block-level tags) are laid one after the other and a suffix array over them, sorted to
the depth of the shortest run that counts, brings equal runs together; runs on enough distinct pages are boilerplate, whatever is
longer is a row of such runs. The blocks that they cover go, unique blocks stay.

A host with many pages is cut into parts, each with a suffix array of its own. A run that is on a given share of a host's
pages is on that share of the pages of one part at least, so the parts' frequent runs are all that can be frequent. Their counts are added up;
where a part that did not name a run could still decide, it is counted in every part, which makes the result the same as with one
array. What is frequent is bounded by the share: a host has at most 1 / share times the tokens of a page. Where pages are so long that one
page of a part is that share, the parts give all their runs.

Then comes what pages say themselves: text inside an article is kept, furniture with a name (menu, footer, sidebar ...) goes.
Where a page names several articles, the runs tell its own from the cards of other stories that the host repeats, in cards or in articles.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from . import markup
from .jaccard import mix
from .shared import stored

RUN = 8  # tokens of the shortest run that counts
SHARE = 0.01  # of a host's distinct pages that have a run, two at least
COVERED = 0.8  # of a block's words that lie in such runs
PART_TOKENS = 1 << 20
HOT_PARTS = 1 << 14
HOT_SIZE = 1 << 23  # characters of a hot host that go to one task, at least
TOKEN_SIZE = 8  # characters of a page for each token, about
IN_ARTICLE = 1 << 33  # added to the numbers of words in articles: their runs are apart from those of other text
STEP = np.uint64(0x9E3779B97F4A7C15)
KNOWN = 1 << 18
HELD_TOKENS = 1 << 18  # of the pages whose texts are taken at once


class Names(dict):
    """Numbers of words and tags: CRC-32, kept for those seen; from 1 up."""

    def __missing__(self, token: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        got = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass")) | 1 << 32
        return got

    of = dict.__getitem__


def several_articles(found: list[markup.Block]) -> bool:
    return len({b.article for b in found if b.article and b.said == markup.ARTICLE}) > 1


def stream(found: list[markup.Block], names: Names) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(token numbers of a page, (start, end) of each block's words). All words are there, those of articles with numbers of their own."""
    out, at = [], []
    for block in found:
        out += [names.of(f"<{t}>") for t in block.tags]
        start = len(out)
        numbers = map(names.of, block.text.split())
        out += [n + IN_ARTICLE for n in numbers] if block.said in (markup.ARTICLE, markup.HEADER) else numbers
        at.append((start, len(out)))
    return np.array(out, dtype=np.int64), at


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """64-bit hash of the run that starts at each place; 0 where it would span a 0 or the end."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h, bad = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=bool)
    for i in range(run):
        h = h * STEP + tokens[i : i + n].astype(np.uint64)
        bad |= tokens[i : i + n] == 0
    h = mix(h) | np.uint64(1)
    h[bad] = 0
    return h


def suffix_groups(tokens: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each run that occurs, number of distinct pages that have it), from a suffix array sorted to depth ``run``.

    ``tokens`` are all pages' tokens; places where no run starts (it would leave the page or span a 0) are left out.
    Prefix doubling: ranks by the first k tokens, taken in pairs k apart, are ranks by the first 2 k.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    reach, depth = (~(tokens == 0)).astype(np.int64), 1
    while depth < run:
        step = min(depth, run - depth)
        after, more = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        after[: n - step], more[: n - step] = rank[step:], reach[step:]
        inside = np.zeros(n, dtype=bool)
        inside[: n - step] = page[step:] == page[: n - step]
        reach = reach & more & inside
        rank = np.unique(rank * (int(after.max(initial=0)) + 1) + after, return_inverse=True)[1].astype(np.int64)
        depth += step
    suffix = np.flatnonzero(reach)
    if not len(suffix):
        return suffix, suffix
    suffix = suffix[np.lexsort((page[suffix], rank[suffix]))]
    r, p = rank[suffix], page[suffix]
    first = np.append(True, r[1:] != r[:-1])
    fresh = first | np.append(True, p[1:] != p[:-1])
    starts = np.flatnonzero(first)
    return suffix[starts], np.add.reduceat(fresh.astype(np.int64), starts)


def is_in(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which values are among the wanted, sorted ones; a bitmap by their low bits leaves few to look up."""
    out = np.zeros(len(values), dtype=bool)
    if len(wanted):
        low = np.uint64((1 << max(10, (16 * len(wanted)).bit_length())) - 1)
        marked = np.zeros(int(low) + 1, dtype=bool)
        marked[wanted & low] = True
        may = np.flatnonzero(marked[values & low])
        place = np.searchsorted(wanted, values[may])
        out[may] = wanted[np.minimum(place, len(wanted) - 1)] == values[may]
    return out


def paged_hashes(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """``run_hashes`` of all pages' tokens; 0 also where the run would leave its page."""
    hashes = run_hashes(tokens, run)
    hashes[page[: len(hashes)] != page[run - 1 : run - 1 + len(hashes)]] = 0
    return hashes


def covered_by(starts: np.ndarray, run: int, size: int) -> np.ndarray:
    """Which of ``size`` tokens lie in the runs that start at the given places."""
    inside = np.zeros(size + 1, dtype=np.int64)
    inside[starts] += 1
    inside[starts + run] -= 1
    return np.cumsum(inside)[:-1] > 0


def chosen_groups(tokens: np.ndarray, page: np.ndarray, run: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``suffix_groups`` over no more than the tokens of the runs that start at the given places, a 0 between pieces that were apart."""
    at = np.flatnonzero(covered_by(starts, run, len(tokens)))
    cuts = np.flatnonzero(np.diff(at) > 1) + 1
    places, pages = suffix_groups(np.insert(tokens[at], cuts, 0), np.insert(page[at], cuts, -1), run)
    return np.insert(at, cuts, -1)[places], pages


def frequent_runs(tokens: np.ndarray, page: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of distinct pages) of the runs on ``least`` distinct pages: only runs with as many places are looked at."""
    hashes = paged_hashes(tokens, page, run)
    places = np.sort(hashes[hashes != 0])
    often = np.unique(places[least - 1 :][places[least - 1 :] == places[: max(0, len(places) - least + 1)]])
    at, pages = chosen_groups(tokens, page, run, np.flatnonzero(is_in(hashes, often)))
    return hashes[at[pages >= least]], pages[pages >= least]


def counted_runs(tokens: np.ndarray, page: np.ndarray, run: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of distinct pages) of the wanted runs (sorted hashes) that occur."""
    hashes = paged_hashes(tokens, page, run)
    at, pages = chosen_groups(tokens, page, run, np.flatnonzero(is_in(hashes, wanted)))
    there = is_in(hashes[at], wanted)
    return hashes[at[there]], pages[there]


def host_of(url: str | Column) -> Column:
    """Lower-cased host of a url; empty for a null url or one without '://'."""
    url = F.col(url) if isinstance(url, str) else url
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


BLOCKS = StructType().add("texts", StringType()).add("tags", StringType()).add("marks", ArrayType(IntegerType()))


def packed(pages: list[list[markup.Block]]) -> dict[str, pa.Array]:
    """Columns for the blocks of pages; a block's text and its tags are a line each."""
    return {
        "texts": pa.array(["\n".join(b.text for b in found) for found in pages], pa.string()),
        "tags": pa.array(["\n".join(" ".join(b.tags) for b in found) for found in pages], pa.string()),
        "marks": pa.array([[b.article << 4 | b.said << 1 | b.heading for b in found] for found in pages], pa.list_(pa.int32()))}


def unpacked(table: pa.Table | pa.RecordBatch):
    """The blocks of each row's page."""
    for texts, tags, marks in zip(*(table.column(c) for c in ("texts", "tags", "marks")), strict=True):
        marks = marks.as_py()
        yield [markup.Block(m >> 1 & 7, bool(m & 1), text, t.split(" ") if t else [], m >> 4) for text, t, m in zip(
            texts.as_py().split("\n"), tags.as_py().split("\n"), marks, strict=True)] if marks else []


def page_hash(html: str | Column = "html") -> Column:
    """Hash of the whole page; null for a null or empty one."""
    html = F.col(html) if isinstance(html, str) else html
    return F.when(html != "", F.xxhash64(html))


def page_blocks(pages: DataFrame) -> DataFrame:
    """``pages`` with the blocks of each page in place of its html."""
    others = [f for f in pages.schema if f.name != "html"]

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = packed([markup.blocks(h.as_py() or "") for h in part.column("html")])
                yield pa.record_batch({**{f.name: part.column(f.name) for f in others}, **found})

    return pages.mapInArrow(read, StructType(others + BLOCKS.fields))


def page_streams(pages: DataFrame) -> DataFrame:
    """host, page (hash of the whole page), tokens of every distinct page."""

    def read(batches):
        names = Names()
        for batch in batches:
            tokens = [stream(found, names)[0] for found in unpacked(batch)]
            yield pa.record_batch({"host": batch.column("host"), "page": batch.column("page"),
                                   "tokens": pa.array(tokens, pa.list_(pa.int64()))})

    once = page_blocks(pages.select("host", page_hash().alias("page"), "html").where("page IS NOT NULL"))
    return once.mapInArrow(read, "host string, page long, tokens array<long>").dropDuplicates(["host", "page"])


def _joined(table: pa.Table, left_out: pa.ChunkedArray, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, number of the page of each) of a table's distinct pages, but those left out."""
    table = table.filter(table.column("page").is_valid())
    page, first = np.unique(table.column("page").to_numpy(), return_index=True)
    table = table.take(pa.array(np.sort(first[~np.isin(page, left_out.drop_null().to_numpy())])))
    if "tokens" in table.column_names:
        tokens = [t.values.to_numpy() for t in table.column("tokens")]
    else:
        tokens = [stream(found, names)[0] for found in unpacked(table)]
    sizes = np.array([len(t) for t in tokens], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.int64), *tokens]), np.repeat(np.arange(len(sizes)), sizes)


def runs_of_parts(dealt: DataFrame, hosts: DataFrame, run: int, copies: DataFrame | None = None) -> DataFrame:
    """host, run_hash of the runs on at least ``least`` distinct pages of their host.

    ``dealt``: host, part, page and tokens or blocks; ``hosts``: host, least, parts; ``copies``: host, part, page of those pages
    that another part of the host counts. Nothing is stored, so that a plan which reads ``dealt`` once more shuffles it once.
    """
    names, nothing = Names(), F.lit(None).cast("long")
    none = hosts.sparkSession.createDataFrame([], "host string, part long, page long")
    copies = (none if copies is None else copies).select("host", "part", F.col("page").alias("copy"), nothing.alias("run_hash"),
                                                         nothing.alias("least"), nothing.alias("parts"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    pages = dealt.groupBy("host", "part")

    def answer(table: pa.Table, hashes: np.ndarray, n: np.ndarray, least: int, parts: int) -> pa.Table:
        host = table.column("host")[0].as_py() if len(hashes) else None
        return pa.table({"host": pa.array([host] * len(hashes), pa.string()), "run_hash": hashes.view(np.int64), "pages": n,
                         "least": np.full(len(hashes), least, np.int64), "parts": np.full(len(hashes), parts, np.int64)})

    def frequent(left: pa.Table, right: pa.Table) -> pa.Table:
        least, parts = (max(right.column(c).drop_null().to_pylist(), default=1) for c in ("least", "parts"))
        tokens, page = _joined(left, right.column("copy"), names)
        return answer(left, *frequent_runs(tokens, page, run, -(-least // parts)), least, parts)

    def counted(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = right.column("run_hash").drop_null().to_numpy().view(np.uint64)
        if not len(wanted) or not left.num_rows:
            return answer(left, np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, 0)
        least, parts = (max(right.column(c).drop_null().to_pylist()) for c in ("least", "parts"))
        tokens, page = _joined(left, right.column("copy"), names)
        return answer(left, *counted_runs(tokens, page, run, np.sort(wanted)), least, parts)

    told = "host string, run_hash long, pages long, least long, parts long"
    asked = hosts.select("host", part, nothing.alias("copy"), nothing.alias("run_hash"), "least", "parts").unionByName(copies)
    found = pages.cogroup(asked.groupBy("host", "part")).applyInArrow(frequent, told).groupBy("host", "run_hash").agg(
        F.sum("pages").alias("pages"), F.count("*").alias("told"), F.first("least").alias("least"), F.first("parts").alias("parts"))
    # Both branches read all columns of the counts, or they would be two plans that each look for the runs.
    sure = found.where("pages >= least AND told > 0 AND parts > 0").select("host", "run_hash")
    if hosts.where("parts > 1").isEmpty():
        return sure
    # A part that did not name a run has it on fewer pages than its share of them.
    unsure = found.where("pages < least AND pages + (parts - told) * ((least - 1) DIV parts) >= least")
    asked = unsure.select("host", part, nothing.alias("copy"), "run_hash", "least", "parts").unionByName(copies)
    totals = pages.cogroup(asked.groupBy("host", "part")).applyInArrow(counted, told).groupBy("host", "run_hash").agg(
        F.sum("pages").alias("pages"), F.first("least").alias("least"))
    return sure.union(totals.where("pages >= least").select("host", "run_hash"))


def least_of(pages: str, share: float) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.col(pages) * share)).cast("long").alias("least")


def repeated_runs(streams: DataFrame, run: int = RUN, share: float = SHARE, part_tokens: int = PART_TOKENS) -> DataFrame:
    """host, run_hash of the runs of ``run`` tokens on at least max(2, share * pages) distinct pages of their host."""
    streams = stored(streams, "pages-streams")
    hosts = stored(streams.groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.size("tokens")).alias("n")).select(
        "host", least_of("pages", share), F.ceil(F.col("n") / part_tokens).cast("long").alias("parts")), "pages-hosts").where("parts > 0")
    dealt = streams.join(hosts.select("host", "parts"), "host").withColumn("part", F.expr("pmod(xxhash64(page, 'part'), parts)")).drop("parts")
    return stored(runs_of_parts(dealt, hosts, run), "pages-boilerplate")


def cards(found: list[markup.Block], at: list[tuple[int, int]], covered: list[int], share: float) -> set[int]:
    """Numbers of a page's articles that repeated runs cover, if one that they do not cover has more words than these together."""
    words, seen = Counter(), Counter()
    for b, (s, e), n in zip(found, at, covered, strict=True):
        if b.article and b.said == markup.ARTICLE:
            words[b.article] += e - s
            seen[b.article] += n
    repeated = {a for a, n in words.items() if seen[a] >= share * n}
    own = max((n for a, n in words.items() if a not in repeated), default=0)
    return repeated if own > sum(words[a] for a in repeated) else set()


def main_blocks(found: list[markup.Block], at: list[tuple[int, int]], covered: np.ndarray, share: float) -> tuple[list[str], int, int, str | None]:
    """(texts that stay, words in repeated blocks, words in those of the only article, what decided) of one page."""
    upto = [0, *np.cumsum(covered).tolist()] if covered.any() else [0] * (len(covered) + 1)
    seen = [upto[e] - upto[s] for s, e in at]
    gone = [e > s and n / (e - s) >= share for (s, e), n in zip(at, seen, strict=True)]
    several = several_articles(found)
    repeated = shared = 0
    for b, (s, e), g in zip(found, at, gone, strict=True):
        if g and b.said == markup.ARTICLE and not several:
            shared += e - s
        elif g:
            repeated += e - s
    for level, basis in ((markup.ARTICLE, "article"), (markup.MAIN, "main")):
        if any(b.said == level for b in found):
            others = cards(found, at, seen, share) if several else set()
            kept = [b.text for b in found if b.article not in others and (
                b.said == level or (level == markup.ARTICLE and b.said == markup.MAIN and b.heading))]
            return kept, repeated, shared, basis
    plain = [(b.text, g) for b, g in zip(found, gone, strict=True) if b.said == markup.OPEN]
    kept = [t for t, g in plain if not g]
    if kept or not plain:
        return kept, repeated, shared, "runs" if kept else None
    return [t for t, _ in plain], repeated, shared, "copy"


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN,
              share: float = SHARE, covered: float = COVERED, part_tokens: int = PART_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated, basis, n_shared of every row of ``pages``.

    text: the blocks that stay, in page order, joined by an empty line; n_chars its code points; n_repeated: words of
    the page in blocks that the host's repeated runs cover, but not those of a page's only article, which are n_shared. basis says what
    decided: 'article' or 'main' (the page names that part, all of its text stays but named furniture and, beside a longer article of the
    page's own, articles that the host repeats), 'runs' (unnamed text that is not repeated), 'copy' (everything unnamed
    is repeated, as in a copy of a whole page: it stays), null (no text).

    A null or empty html gives an empty text. Pages without a host in their url form one host. A repeated row gets its
    result each time, but counts as one page when runs are counted, as all rows with equal html do. Only the
    three columns named are read, so further columns cannot clash. Nothing is cut or capped, however long a page is.

    Each page is read once, and its blocks travel once, to a part of their host: the parts' runs, their counts and the texts all come from that
    shuffle. Hosts with more than 1/16384 of all text (and more than 8 million characters, or ``part_tokens`` tokens of 8, if that
    is less) have several parts, up to four times as large where a run on one page of a part could be frequent otherwise; at most
    16384 such hosts can exist, and only their names reach the driver. A task holds one part's pages at a time. Rows that are equal
    in all three columns meet in one part.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumns(
        {"host": host_of("url"), "page": page_hash("html")})
    sizes = stored(
        rows.groupBy("host", "page").agg(F.sum(F.coalesce(F.length("html"), F.lit(0)) + 1).alias("size"))
        .groupBy("host").agg(F.count("page").alias("pages"), F.sum("size").alias("size")), "pages-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 1
    unit = max(total / HOT_PARTS, min(HOT_SIZE, TOKEN_SIZE * part_tokens))
    hosts = sizes.select("host", "size", least_of("pages", share), F.ceil(F.greatest(F.col("size") / unit, F.lit(1))).cast("long").alias("parts"))
    fewer = F.col("least") - 1  # with these, a run that is frequent is on two pages of a part
    hosts = hosts.select("host", "least", F.when((F.col("parts") > fewer) & (F.col("size") <= fewer * 4 * unit), fewer).otherwise(F.col("parts")).alias("parts"))
    hot = hosts.where("parts > 1").select("host", "parts").collect()
    hot = F.broadcast(pages.sparkSession.createDataFrame([tuple(r) for r in hot], "host string, parts long"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    part = F.pmod(F.xxhash64("page_id", "url", "page"), parts).alias("part")
    dealt = page_blocks(rows.join(hot, "host", "left").select("host", part, "page", "page_id", "url", "html"))
    copies = (
        rows.join(hot, "host").where("page IS NOT NULL").groupBy("host", "page").agg(F.collect_set(part).alias("there"))
        .select("host", "page", F.explode(F.array_except("there", F.array(F.array_min("there")))).alias("part")))
    known = runs_of_parts(dealt, hosts, run, copies).join(hot, "host", "left").select(
        "host", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), "run_hash")
    kind, names = rows.schema["page_id"].dataType.simpleString(), Names()

    def texts(found: list, at: list, tokens: list[np.ndarray], wanted: np.ndarray):
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        joined, page = np.concatenate([np.zeros(0, np.int64), *tokens]), np.repeat(np.arange(len(sizes)), sizes)
        starts = np.flatnonzero(is_in(paged_hashes(joined, page, run), wanted))
        inside = np.split(covered_by(starts, run, len(joined)), np.cumsum(sizes)[:-1])
        for blocks, places, there in zip(found, at, inside, strict=True):
            kept, repeated, shared, basis = main_blocks(blocks, places, there, covered)
            text = "\n\n".join(kept)
            yield text, len(text), repeated, basis, shared

    def extract(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = np.sort(right.column("run_hash").to_numpy().view(np.uint64))
        out, found, at, tokens, held = [], [], [], [], 0
        for number, blocks in enumerate(unpacked(left), 1):
            numbers, places = stream(blocks, names)
            found.append(blocks)
            at.append(places)
            tokens.append(numbers)
            held += len(numbers)
            if held >= HELD_TOKENS or number == left.num_rows:
                out += texts(found, at, tokens, wanted)
                found, at, tokens, held = [], [], [], 0
        text, n, repeated, basis, shared = zip(*out, strict=True) if out else [()] * 5
        return pa.table({
            "page_id": left.column("page_id"), "url": left.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array(n, pa.int64()),
            "n_repeated": pa.array(repeated, pa.int64()), "basis": pa.array(basis, pa.string()), "n_shared": pa.array(shared, pa.int64())})

    return dealt.groupBy("host", "part").cogroup(known.groupBy("host", "part")).applyInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long, n_repeated long, basis string, n_shared long")


#: DuckDB twin for pages that name their article and nest nothing in it but blocks and plain inline markup.
ORACLE = r"""
WITH cut AS (
  SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '</?(?:p|h[1-6]|div|ul|li)>'),
    lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      b, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda b: b <> '') AS b
  FROM pages
)
SELECT page_id, url, array_to_string(b, chr(10) || chr(10)) AS text, CAST(length(array_to_string(b, chr(10) || chr(10))) AS BIGINT) AS n_chars FROM cut
"""
