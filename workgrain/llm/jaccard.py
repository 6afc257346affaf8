"""Exact Jaccard join on word n-grams: size-banded tiles, bitmap bounds, sorted-array intersection.

How a link cannot be missed. Let two sets have Jaccard similarity of at least t and let the smaller one have at
most H members (H: the end of its size band). Then they differ in at most k = H(1−t)/t members. Members are dealt
by hash into m > k parts, so at least one part is the same in both; documents meet in the tile of that part. A
part without members says nothing, so m has slack for empty parts, and a set with more empty parts than that is
dealt again with another seed (and again, until a seed suits it): of two similar sets the one that stops first
has a filled part that the other one shares. Sets so small that k ≤ 1 meet by their members less one, and only where a
set and the set without one member are that similar at all: below that size only equal sets link.

In the tiles, bitmaps of hashed members bound the overlap from above; pairs that the bound lets through are
compared by intersecting sorted arrays. Documents with equal sets are one node from the start.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, discard, may_be_in, sketch, stored

M64 = (1 << 64) - 1
MULTIPLIER = 0x9E3779B97F4A7C15
GROWTH = 1.5
BLOCK = 2048
MOST_SEEDS = 64
LIKELIEST_ROUNDS = 1
BATCH_KEYS = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words; a shorter text is one run; no word: empty.

    A-Z are lower-cased; words are separated by space, tab, line feed, vertical tab, form feed or carriage return.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(h))
    run = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        run = run * np.uint64(MULTIPLIER) + h[i : len(h) - n + 1 + i]
    return np.unique(mix(run + np.uint64(n * 0x632BE59BD9B4E019 & M64)))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(members: np.ndarray, seed: int = 0) -> int:
    """64-bit name of a whole set, as a signed number."""
    return signed(xxhash.xxh3_64_intdigest(members.tobytes(), seed))


@dataclass(frozen=True)
class Band:
    """Sizes ``low`` to ``high`` of the smaller set, up to ``top`` of the larger one."""

    low: int
    high: int
    top: int
    parts: int
    slack: int


class Bands:
    """Size bands for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self._bands = num, den, []

    def _differ(self, high: int) -> int:
        return high * (self.den - self.num) // self.num

    def _grow(self) -> None:
        low = self._bands[-1].high + 1 if self._bands else 1
        if not self._bands:  # all sizes of which similar sets differ in one member at most
            high = 1
            while self._differ(high + 1) <= 1:
                high += 1
            parts, slack = 0, 0
        else:
            high = max(low, int(low * GROWTH))
            slack = 0
            for _ in range(6):
                parts = self._differ(high) + 1 + slack
                empty = parts * math.exp(-low / parts)
                slack = min(math.ceil(empty + 1.5 * math.sqrt(empty)), max(2, parts // 4))
            parts = self._differ(high) + 1 + slack
        self._bands.append(Band(low, high, high * self.den // self.num, parts, slack))

    def of(self, size: int) -> list[tuple[int, Band]]:
        """The bands that a set of this size has to appear in."""
        while not self._bands or self._bands[-1].high < size:
            self._grow()
        return [(i, b) for i, b in enumerate(self._bands) if b.low <= size <= b.top]

    def keys(self, members: np.ndarray) -> np.ndarray:
        """Tile keys of a set."""
        out = []
        for number, band in self.of(len(members)) if len(members) else ():
            salt = (number + 1) * 0xD6E8FEB86659FD93 & M64
            if not band.parts:
                n, spread = len(members), mix(members)
                whole = spread.sum(dtype=np.uint64)
                met = [whole - spread] * ((n - 1) * self.den >= self.num * n) + [whole[None]] * (n * self.den >= self.num * (n + 1))
                out += [mix(m + np.uint64(salt)) for m in met]
                continue
            for seed in range(MOST_SEEDS):
                dealt = members if seed == 0 else np.sort(mix(members + np.uint64(seed * MULTIPLIER & M64)))
                part = ((dealt >> np.uint64(32)) * np.uint64(band.parts) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                body = np.add.reduceat(mix(dealt), first)
                tag = np.uint64((salt + seed * 0xA0761D6478BD642F) & M64) + part[first].astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
                out.append(mix(body ^ mix(tag)))
                if band.parts - len(first) <= band.slack:
                    break
            else:  # no seed suits it: such sets also meet in their empty parts
                out.append(mix(np.arange(band.parts, dtype=np.uint64) + np.uint64(salt ^ 0x8EBC6AF09C88C6E3)))
        return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def bitmap(members: np.ndarray) -> np.ndarray:
    """One bit for each member, by its low bits, in 4 to 8 times as many bits as members."""
    bits = max(64, 1 << (4 * len(members) - 1).bit_length())
    out = np.zeros(bits, dtype=np.uint8)
    out[(members & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap that the same members have in fewer words."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def most_shared(n_a, bits_a: np.ndarray, n_b, bits_b: np.ndarray):
    """Upper bound of the intersection: members whose bit the other set lacks are not shared."""
    only_a = np.bitwise_count(bits_a & ~bits_b).sum(axis=-1).astype(np.int64)
    only_b = np.bitwise_count(bits_b & ~bits_a).sum(axis=-1).astype(np.int64)
    return np.minimum(n_a - only_a, n_b - only_b)


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Bitmap bound first, then the exact intersection of two sorted arrays."""
    bits_a, bits_b = bitmap(a), bitmap(b)
    words = min(len(bits_a), len(bits_b))
    most = int(most_shared(len(a), folded(bits_a, words), len(b), folded(bits_b, words)))
    if den * most < num * (len(a) + len(b) - most):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int((b[at] == a).sum())
    return den * shared >= num * (len(a) + len(b) - shared)


def _features(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """doc_id, text_hash, n, node, check: size and two independent names of every document's set."""

    def measure(batches):
        for batch in batches:
            told = [(len(m := shingle_set(t.as_py(), words)), node_of(m, 2 * seed), node_of(m, 2 * seed + 1)) for t in batch.column("text")]
            n, node, check = zip(*told, strict=True) if told else ((), (), ())
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": pa.array(n, pa.int64()),
                "node": pa.array(node, pa.int64()), "check": pa.array(check, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(measure, f"doc_id {kind}, text_hash long, n long, node long, check long")


def _named(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame, int]:
    """(features, nodes, seed): every set has a 64-bit name of its own; nodes are the distinct sets.

    Should two different sets have one name, which a second name tells, all are named anew with another seed.
    """
    for seed in range(MOST_SEEDS):
        features = stored(_features(docs, words, seed), "jaccard-sets")
        nodes = stored(
            features.where("n > 0").groupBy("node").agg(
                F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"),
                F.count("*").alias("times"), F.min("check").alias("low"), F.max("check").alias("high")), "jaccard-nodes")
        if nodes.where("low <> high").isEmpty():
            return features.drop("check"), nodes.select("node", "first", "times"), seed
    raise AssertionError("unreachable")


def _row_mark(doc_id, text_hash):
    return F.xxhash64(doc_id, text_hash).alias("mark")


def _keys(docs: DataFrame, nodes: DataFrame, words: int, num: int, den: int, seed: int) -> DataFrame:
    """key, node: the tile keys of each distinct set, made from the text again and never stored.

    A sketch lets through the text that each set was first seen in, and few others, whose rows repeat.
    """

    def deal(batches):
        bands = Bands(num, den)
        for batch in batches:
            keys, nodes, held = [], [], 0
            for text in batch.column("text"):
                members = shingle_set(text.as_py(), words)
                keys.append(bands.keys(members).view(np.int64))
                nodes.append(np.full(len(keys[-1]), node_of(members, 2 * seed)))
                held += len(keys[-1])
                if held >= BATCH_KEYS:
                    yield pa.record_batch({"key": np.concatenate(keys), "node": np.concatenate(nodes)})
                    keys, nodes, held = [], [], 0
            if held:
                yield pa.record_batch({"key": np.concatenate(keys), "node": np.concatenate(nodes)})

    first = sketch(nodes.select(_row_mark("first.doc_id", "first.text_hash")))
    return docs.where(may_be_in(_row_mark("doc_id", "text_hash"), first)).select("text").mapInArrow(deal, "key long, node long")


def _tiles(keys: DataFrame) -> DataFrame:
    """(key, node) of tiles with several nodes; of tiles with the same nodes one stays.

    The keys are made and shuffled once: what tells tiles apart is added up beside their rows.
    """
    tile = Window.partitionBy("key")
    mark = [F.sum(F.pmod(F.xxhash64("node", F.lit(s)), F.lit(1 << 32))).over(tile).alias(f"s{s}") for s in (1, 2)]
    marked = keys.select("key", "node", F.min("node").over(tile).alias("low"), F.max("node").over(tile).alias("high"),
                         F.count("*").over(tile).alias("c"), *mark)
    told = [F.xxhash64(*order).alias(f"m{i}") for i, order in enumerate((["low", "high", "c", "s1", "s2"], ["s2", "s1", "c", "high", "low"]))]
    shared = stored(marked.where("low < high").select("key", "node", *told), "jaccard-shared")
    chosen = shared.groupBy("m0", "m1").agg(F.min("key").alias("key")).select("key")
    tiles = stored(shared.select("key", "node").join(chosen, "key", "left_semi").distinct(), "jaccard-tiles")
    discard(shared)
    return tiles


def _texts(docs: DataFrame, nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """node, text: one text for every node that is in a tile. Texts travel once, and only those that a sketch lets through."""
    wanted = stored(nodes.join(tiles.select("node").distinct(), "node").select(
        "node", _row_mark("first.doc_id", "first.text_hash").alias("mark"),
        F.col("first.text_hash").alias("wanted_hash"), F.col("first.doc_id").alias("wanted_id")), "jaccard-wanted")
    marked = docs.withColumn("mark", _row_mark("doc_id", "text_hash"))
    some = marked.where(may_be_in(F.col("mark"), sketch(wanted.select("mark"))))
    same = (F.col("text_hash") == F.col("wanted_hash")) & F.col("doc_id").eqNullSafe(F.col("wanted_id"))
    return some.join(wanted, "mark").where(same).dropDuplicates(["mark", "node"]).select("node", "text")


def _bitmaps(texts: DataFrame, words: int) -> DataFrame:
    """node, n, bits: size and bitmap of every set."""

    def build(batches):
        for batch in batches:
            told = [(len(m := shingle_set(t.as_py(), words)), bitmap(m).tobytes()) for t in batch.column("text")]
            n, bits = zip(*told, strict=True) if told else ((), ())
            yield pa.record_batch({"node": batch.column("node"), "n": pa.array(n, pa.int64()), "bits": pa.array(bits, pa.binary())})

    return texts.mapInArrow(build, "node long, n long, bits binary")


def _checked(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) that link. Only texts of nodes in a pair travel."""

    @F.arrow_udf("boolean")
    def test(a: pa.Array, b: pa.Array) -> pa.Array:
        last, members, out = None, None, []
        for x, y in zip(a, b, strict=True):
            if (text := y.as_py()) != last:  # rows come in the order of b
                last, members = text, shingle_set(text, words)
            out.append(linked(shingle_set(x.as_py(), words), members, num, den))
        return pa.array(out, pa.bool_())

    there = sketch(pairs.select(F.explode(F.array(F.xxhash64("a"), F.xxhash64("b"))).alias("mark")))
    some = texts.where(may_be_in(F.xxhash64("node"), there))
    left = some.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = some.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").where(test("text_a", "text_b")).select("a", "b")


def _likeliest(size: int, component: np.ndarray, a: np.ndarray, b: np.ndarray, likeness: np.ndarray) -> np.ndarray:
    """Pairs, likeliest first, that join what is still apart: at most one fewer than there are rows."""
    up = list(range(size))
    first: dict[int, int] = {}
    for row, c in enumerate(component.tolist()):  # rows of a component are one from the start
        up[row] = first.setdefault(c, row)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    chosen = []
    order = np.argsort(-likeness, kind="stable")
    for at, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[y] = x
            chosen.append(at)
    return np.array(chosen, dtype=np.int64)


def _unsettled(tiles: DataFrame, settled: DataFrame | None, sets: DataFrame, num: int, den: int, every_pair: bool) -> DataFrame:
    """Pairs of a tile from different components that the bitmap bound lets through, by blocks of the tile.

    Columns key, a, b: either every such pair, or of each block those that would join its components if they
    link, and then a row without a pair for each block that has further ones.
    """

    def compare(table: pa.Table) -> pa.Table:
        node, comp = (table.column(c).to_numpy() for c in ("node", "component"))
        block = table.column("block").to_numpy()
        one, two = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        maps = [np.frombuffer(b.as_py(), np.uint64) for b in table.column("bits")]
        n = table.column("n").to_numpy()
        words = min(map(len, maps))
        bits = np.stack([folded(b, words) for b in maps])
        a, b, likeness = [], [], []
        for x in np.flatnonzero(block == one):
            other = np.flatnonzero((block == two) & (comp != comp[x]) & ((node > node[x]) | (one != two)))
            if len(other):
                most = most_shared(n[x], bits[x], n[other], bits[other])
                near = den * most >= num * (n[x] + n[other] - most)
                other, most = other[near], most[near]
                a.append(np.full(len(other), x))
                b.append(other)
                likeness.append(most / (n[x] + n[other] - most))
        none = [np.zeros(0, dtype=np.int64)]
        a, b = np.concatenate(a or none), np.concatenate(b or none)
        low, high = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
        none = np.zeros(len(a), dtype=bool)
        if not every_pair and len(a):
            chosen = _likeliest(len(node), comp, a, b, np.concatenate(likeness))
            if len(chosen) < len(a):  # a row without a pair: this tile has more to try
                low, high, none = np.append(low[chosen], 0), np.append(high[chosen], 0), np.arange(len(chosen) + 1) == len(chosen)
            else:
                low, high = low[chosen], high[chosen]
        key = np.full(len(low), table.column("key")[0].as_py(), dtype=np.int64)
        return pa.table({"key": key, "a": pa.array(low, mask=none), "b": pa.array(high, mask=none)})

    component = F.col("node") if settled is None else F.coalesce("component", "node")
    known = (tiles if settled is None else tiles.join(settled, "node", "left")).select(
        "key", "node", component.alias("component"))
    open_tiles = known.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where("low < high")
    rows = known.join(open_tiles.select("key", "c"), "key")
    blocks = F.ceil(F.col("c") / BLOCK).cast("long")
    dealt = (
        rows.join(sets.select("node", "n", "bits"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), blocks))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"),
                "block", "node", "component", "n", "bits"))
    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "key long, a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       num: int = 85, den: int = 100) -> DataFrame:
    """Per row: doc_id, text_hash (xxhash64 of the text), n_shingles, component_id, representative (one text a component).

    Documents link when den * intersection >= num * union of their sets of ``words``-word runs; component_id is
    the smallest doc_id reachable by links, itself included. A null or empty text, or one without words, has
    0 shingles, links with nothing and keeps its own id. Rows with a null id take part and name no component
    (a component without any id has null). A repeated row gets its result once for each time it occurs.

    Sets are compared by 64-bit hashes of their members. No tile is capped: tiles with many documents are split
    into blocks. First come LIKELIEST_ROUNDS rounds that try, in each block, only pairs that would join its
    components, likeliest first; then, in tiles that still hold several components, every pair from different
    components that passes the bitmap bound is compared. So large groups of near copies are joined by about
    as many comparisons as they have members, and no link between components is missed. Links inside a component are
    not all found: ``link_counts`` has their number.
    """
    if 2 * num < den:
        raise ValueError("tiles are selective for a similarity of one half or more only")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    features, nodes, seed = _named(rows, words)
    tiles = _tiles(_keys(rows, nodes, words, num, den, seed))
    texts = stored(_texts(rows, nodes, tiles), "jaccard-texts")
    sets = stored(_bitmaps(texts, words), "jaccard-bitmaps")
    links, tried, settled = None, None, None
    for every_pair in (False,) * LIKELIEST_ROUNDS + (True,):
        found = stored(_unsettled(tiles, settled, sets, num, den, every_pair), "jaccard-pairs")
        pairs = found.where("a IS NOT NULL").select("a", "b").distinct()
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-candidates")
        tiles = tiles.join(found.where("a IS NULL").select("key").distinct(), "key", "left_semi")
        new = stored(_checked(pairs, texts, words, num, den), "jaccard-links")
        links, tried = (new, pairs) if links is None else (links.union(new), tried.union(pairs))
        settled = components(links)
    labels = (
        nodes.join(settled, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"), "first"))
    leaders = labels.groupBy("component").agg(F.min("first").alias("leader"))
    named = labels.join(leaders, "component").select("node", "leader")
    alone = F.col("n_shingles") == 0
    plain = features.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node")
    return (
        plain.join(named, "node", "left")
        .select("doc_id", "text_hash", "n_shingles",
                F.when(alone, F.col("doc_id")).otherwise(F.col("leader.doc_id")).alias("component_id"),
                (alone | (F.col("doc_id").eqNullSafe(F.col("leader.doc_id"))
                          & (F.col("text_hash") == F.col("leader.text_hash")))).alias("representative")))


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, num: int = 85,
                den: int = 100) -> DataFrame:
    """Per row: doc_id, text_hash, n_links: the number of other rows that it links with, by the rule of the components.

    Every pair of different sets that the bitmap bound lets through is compared, once however many tiles it shares;
    rows with equal sets link with each other, and each occurrence of a repeated row counts. The pairs of a group
    grow with the square of its distinct sets, unlike the comparisons that the components need.
    """
    if 2 * num < den:
        raise ValueError("tiles are selective for a similarity of one half or more only")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    features, nodes, seed = _named(rows, words)
    tiles = _tiles(_keys(rows, nodes, words, num, den, seed))
    texts = stored(_texts(rows, nodes, tiles), "jaccard-texts")
    sets = stored(_bitmaps(texts, words), "jaccard-bitmaps")
    pairs = stored(_unsettled(tiles, None, sets, num, den, True).select("a", "b").distinct(), "jaccard-pairs")
    links = stored(_checked(pairs, texts, words, num, den), "jaccard-links")
    both = links.select(F.col("a").alias("own"), F.col("b").alias("node")).union(links.select("b", "a"))
    others = both.join(nodes.select("node", "times"), "node").groupBy(F.col("own").alias("node")).agg(F.sum("times").alias("others"))
    counted = nodes.join(others, "node", "left").select(
        "node", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return features.select("doc_id", "text_hash", "n", "node").join(counted, "node", "left").select(
        "doc_id", "text_hash", F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Rows without any word stay; a row that repeats exactly (id and text) stays once.
    """
    rows = stored(jaccard_components(docs, id_col, text_col, **how), "jaccard-rows")
    told = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("times"), F.bool_or("representative").alias("stays"))
    doubtful = stored(told.where("times > 1 OR NOT stays").select(
        _row_mark("doc_id", "text_hash").alias("mark"), F.col("doc_id").alias("known_id"), F.col("text_hash").alias("known_hash"), "stays"), "jaccard-doubtful")
    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    maybe = whole.withColumn("maybe", may_be_in(_row_mark("doc_id", "text_hash"), sketch(doubtful.select("mark"))))
    same = F.col("doc_id").eqNullSafe(F.col("known_id")) & (F.col("text_hash") == F.col("known_hash"))
    order = Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))
    checked = (
        maybe.where("maybe").join(doubtful.where("NOT stays"), same, "left_anti")
        .withColumn("nth", F.row_number().over(order)).where("nth = 1"))
    return maybe.where("NOT maybe").select("row.*").union(checked.select("row.*"))
