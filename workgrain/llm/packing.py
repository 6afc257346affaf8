"""Packing tokenised documents into sequences: Martello-Toth reduction, then best fit for what it leaves.

Both work on the histogram of piece lengths, which has at most one row for each length up to the capacity, so the
plan costs the same for any number of documents. Tasks then place their own pieces by rank within a length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import stored

CAPACITY = 2048
SPECIAL = "<|endoftext|>"
PIECES_PER_BATCH = 4096


@lru_cache(maxsize=2)
def special_reader(json_path: str) -> Tokenizer:
    return Tokenizer.from_file(json_path)


@lru_cache(maxsize=4)
def encoder(json_path: str, ranks_path: str):
    """text → ids of ``tokenizers`` with the json file.

    tiktoken with the same vocabulary as ranks gives the same ids about four times as fast; texts that hold
    the special token's own string go through ``tokenizers``, which reads it as that token.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(special_reader(json_path).encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(fast.encode_ordinary(text), dtype="<u4")

    return encode


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces behind a shorter first one."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


# --- the plan: counts by length → patterns -------------------------------------------------------------------------


class Stock:
    """Counts of lengths still to be packed, with their distinct lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = Counter({k: v for k, v in counts.items() if v > 0})
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect_left(self.sizes, size)]

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes[:n]:
            out += [s] * min(self.count[s], n - len(out))
        return out[:n]

    def largest_up_to(self, room: int) -> int | None:
        at = bisect_left(self.sizes, room + 1)
        return self.sizes[at - 1] if at else None


def reduce_stock(stock: Stock, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Sequences that some best packing contains: (how many, {length: pieces in each}).

    For a piece j a set is fixed if it dominates every other set that holds j, that is, if the others can be
    turned into it by exchanging pieces for pieces (or groups of pieces) that take no less room:
    j alone if nothing fits beside it; j and k if they fill the sequence, or if k is the largest that fits
    and whatever else fits beside j, one piece or two, is no longer than k.
    """
    fixed: list[tuple[int, dict[int, int]]] = []
    moved = True
    while moved:
        moved = False
        for j in list(reversed(stock.sizes)):
            while stock.count.get(j):
                partner = _partner(stock, j, capacity)
                if partner is None:
                    break
                if partner == 0:
                    n, held = stock.count[j], {j: 1}
                elif partner == j:
                    n, held = stock.count[j] // 2, {j: 2}
                else:
                    n, held = min(stock.count[j], stock.count[partner]), {j: 1, partner: 1}
                for size, each in held.items():
                    stock.take(size, n * each)
                fixed.append((n, held))
                moved = True
    return fixed


def _partner(stock: Stock, j: int, capacity: int) -> int | None:
    """The piece to fix beside j; 0: none is needed; None: no set of one or two dominates."""
    room = capacity - j
    stock.count[j] -= 1  # j itself is not its own partner
    gone = not stock.count[j]
    if gone:
        del stock.sizes[bisect_left(stock.sizes, j)]
    try:
        least = stock.smallest(3)
        if not least or least[0] > room:
            return 0
        best = stock.largest_up_to(room)
        if best == room or len(least) < 2 or least[0] + least[1] > room:
            return best
        if len(least) == 3 and sum(least) <= room:
            return None
        return best if _best_pair(stock, room) <= best else None
    finally:
        if gone:
            insort(stock.sizes, j)
        stock.count[j] += 1


def _best_pair(stock: Stock, room: int) -> int:
    """Largest sum of two pieces that fits."""
    sizes, low, high, best = stock.sizes, 0, bisect_left(stock.sizes, room) - 1, 0
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or (low == high and stock.count[sizes[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def best_fit(stock: Stock, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Longest first, each piece into the fullest sequence that has room; equal sequences are handled together."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, held: dict[int, int]) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([n, held])

    for size in reversed(stock.sizes):
        left = stock.count[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                put(capacity, -(-left // (capacity // size)), {})
                continue
            room = rooms[at]
            n, held = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            each = room // size
            full, rest = divmod(min(left, n * each), each)
            put(room - each * size, full, held | {size: each})
            put(room - rest * size, int(rest > 0), held | {size: rest})
            put(room, n - full - (rest > 0), held)
            left -= full * each + rest
    return [(n, held) for room in rooms for n, held in open_[room] if held]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[str, np.ndarray]:
    """Runs of ranks by length: rank r of a run goes to sequence first + (r−start)//each, at offset + (r−start)%each·length."""
    stock = Stock(counts)
    patterns = reduce_stock(stock, capacity)
    patterns += best_fit(stock, capacity)
    runs, used, sequence = [], Counter(), 0
    for n, held in patterns:
        offset = 0
        for size in sorted(held, reverse=True):
            runs.append((size, used[size], sequence, held[size], offset))
            used[size] += n * held[size]
            offset += size * held[size]
        sequence += n
    assert used == Counter({k: v for k, v in counts.items() if v > 0})
    runs.sort()
    columns = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "start", "sequence", "each", "offset"), columns, strict=True)) | {"sequences": sequence}


# --- the Spark part ------------------------------------------------------------------------------------------------


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, json_path: str, ranks_path: str,
           end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of every document with their rank among the pieces of equal length in the same task."""

    def cut(batches):
        encode = encoder(json_path, ranks_path)
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()

        def packed(rows):
            at, piece, start, length, crc, rank, ids = zip(*rows, strict=True)
            out = {
                "doc_id": source.take(pa.array(at)), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array([part] * len(rows), pa.int64()),
                "rank": pa.array(rank, pa.int64())}
            if with_ids:
                out["ids"] = pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))
            return pa.record_batch(out)

        for batch in batches:
            source, rows = batch.column("doc_id"), []
            for at, text in enumerate(batch.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.array([end_id], dtype="<u4"))
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[start : start + length]
                    rows.append((at, piece, start, length, zlib.crc32(own.tobytes()), int(ranks[length]), own))
                    ranks[length] += 1
                    if len(rows) == PIECES_PER_BATCH:
                        yield packed(rows)
                        rows = []
            if rows:
                yield packed(rows)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part long, rank long"
        + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         json_path: str | None = None, ranks_path: str | None = None, end_id: int = 0,
         with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    A document is its ids followed by ``end_id``; a null text counts as empty and gives that id alone. Only
    documents beyond the capacity are cut. Rows with equal or null ids are documents of their own. An empty
    table gives no rows. The driver sees one count for each length up to the capacity and nothing else.
    """
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    cut = stored(pieces(docs, id_col, text_col, capacity, json_path, ranks_path, end_id, with_ids), "packing-pieces")
    each = cut.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = stored(each.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-bases")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    shift = int(max((counts[k] for k in counts), default=0)).bit_length()
    starts = (runs["length"] << shift) + runs["start"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = np.searchsorted(starts, (length << shift) + rank, side="right") - 1
            own = rank - runs["start"][run]
            sequence = runs["sequence"][run] + own // runs["each"][run]
            offset = runs["offset"][run] + own % runs["each"][run] * length
            kept = {c: batch.column(c) for c in batch.schema.names if c != "rank"}
            yield pa.record_batch(kept | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    ranked = cut.join(bases.select("part", "length", "base"), ["part", "length"]).withColumn(
        "rank", F.col("rank") + F.col("base"))
    kept = [c for c in cut.columns if c not in ("part", "rank")]
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema}
    return ranked.select(*kept, "rank").mapInArrow(
        place, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", sequence_id long, offset long")


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of the finished sequences, from ``pack(..., with_ids=True)``; a group holds at most the capacity."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda s: s["ids"])).alias("ids"))
