"""Importance resampling towards a target text: hashed n-gram counts, log-ratio weights, Gumbel top-k draw.

The hash of a feature is the CRC-32 of its bytes. CRC-32 is linear over XOR: a text's value is the XOR of one
term per byte, which depends on the byte and on its distance from the text's end, and of one term for the length. So one
table holds the terms of all bytes at the first ``BLOCK`` distances, ``numpy.bitwise_xor.reduceat`` folds the
terms of all spans of a batch at once, and spans longer than a block fold block by block, the value so far being
moved on by a block of bytes through four further tables.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .shared import stored

POLYNOMIAL = 0xEDB88320
BLOCK = 64
ROOM = 1 << 20  # bytes of text that are hashed at once


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms [distance, byte], constants [length up to a block], move [byte of the value, its content])."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))

    def next_zero(value: np.ndarray) -> np.ndarray:
        return (value >> np.uint32(8)) ^ one[value & np.uint32(255)]

    terms = [one]
    for _ in range(BLOCK - 1):
        terms.append(next_zero(terms[-1]))
    start = np.array([0xFFFFFFFF], dtype=np.uint32)
    lengths = [start]
    for _ in range(BLOCK):
        lengths.append(next_zero(lengths[-1]))
    move = []
    for byte in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        for _ in range(BLOCK):
            value = next_zero(value)
        move.append(value)
    return np.stack(terms), np.concatenate(lengths), np.stack(move)


def crc32_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of data[start:end] for each span; the spans may overlap, an empty one gives 0."""
    terms, lengths, move = tables()
    size = (end - start).astype(np.int64)
    out = np.zeros(len(size), dtype=np.uint32)
    blocks = -(-size // BLOCK)
    first = size - np.maximum(blocks - 1, 0) * BLOCK  # the block that is not full comes first
    value = lengths[first].copy()
    value[size == 0] = 0xFFFFFFFF
    for step in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > step)
        if step:
            v = value[live]
            value[live] = (move[0][v & np.uint32(255)] ^ move[1][(v >> np.uint32(8)) & np.uint32(255)]
                           ^ move[2][(v >> np.uint32(16)) & np.uint32(255)] ^ move[3][v >> np.uint32(24)])
        low = start[live] + (first[live] + (step - 1) * BLOCK if step else 0)
        high = start[live] + first[live] + step * BLOCK
        n = high - low
        edge = np.cumsum(n) - n
        at = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(edge - low, n)
        value[live] ^= np.bitwise_xor.reduceat(terms[np.repeat(high, n) - 1 - at, data[at]], edge)
    np.bitwise_xor(value, np.uint32(0xFFFFFFFF), out=out)
    return out


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased byte, whether it belongs to a word): digits, A-Z, a-z and all bytes outside ASCII do."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    part = np.zeros(256, dtype=bool)
    part[48:58] = part[97:123] = part[65:91] = part[128:] = True
    return lower, part


def words_of(data: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word of texts that lie one after the other; a word never spans two texts."""
    _, part = letters()
    inside = part[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begin = row_start[:-1][row_start[:-1] < row_start[1:]]
    first[begin] = inside[begin]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[begin[1:] - 1] = inside[begin[1:] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(row_start, start, side="right") - 1


def features_of(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, its row, words of every row): runs of 1 to ``longest`` words joined by one space."""
    lower, _ = letters()
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(texts), dtype=np.int64)
    data = lower[raw]
    start, end, row = words_of(data, offsets)
    n_words = np.bincount(row, minlength=len(texts)).astype(np.int64)
    if longest > 1:  # words side by side with one space between, so that a run of words is one span
        size = end - start
        at = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(at - np.cumsum(size) + size, size)] = data[
            np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)]
        data, start, end = joined, at, at + size
    got, rows = [], []
    for n in range(1, longest + 1):
        if len(start) < n:
            break
        same = row[n - 1 :] == row[: len(row) - n + 1]
        got.append(crc32_of_spans(data, start[: len(start) - n + 1][same], end[n - 1 :][same]) % np.uint32(buckets))
        rows.append(row[n - 1 :][same])
    return np.concatenate(got).astype(np.int64) if got else np.zeros(0, np.int64), np.concatenate(rows) if rows else row, n_words


def parts(batch: pa.RecordBatch, column: str):
    """Slices of a batch with about ``ROOM`` bytes of text; a longer text is a slice of its own."""
    size = np.cumsum([0, *(len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column))])
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + ROOM, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """bucket, n: occurrences of all features of all texts, added up in each task first."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in parts(batch, "text"):
                total += np.bincount(features_of(part.column("text"), longest, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(there, pa.int64()), "n": pa.array(total[there], pa.int64())})

    rows = texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame, text_col: str, longest: int, buckets: int) -> np.ndarray:
    """Gain of each bucket; the driver gets one number for each bucket and side, ``buckets`` at most."""
    counted = []
    for texts in (target, documents):
        n = np.zeros(buckets, dtype=np.int64)
        got = bucket_counts(texts, text_col, longest, buckets).toArrow()
        n[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
        counted.append(n)
    (t, s), (t_all, s_all) = counted, (float(n.sum()) for n in counted)
    ratio = ((t + 1.0) * (s_all + buckets)) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def weigh(documents: DataFrame, gain: np.ndarray, longest: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row."""
    buckets = len(gain)

    def measure(batches):
        for batch in batches:
            for part in parts(batch, "text"):
                found, row, n_words = features_of(part.column("text"), longest, buckets)
                weight = np.zeros(part.num_rows, dtype=np.int64)
                np.add.at(weight, row, gain[found])
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "n_words": pa.array(n_words, pa.int64()),
                    "n_features": pa.array(np.bincount(row, minlength=part.num_rows), pa.int64()), "weight": pa.array(weight, pa.int64())})

    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(measure, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from the first 8 hex digits of sha256('seed:id'); null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(documents: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
             percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``documents``; rank is null for rows not drawn.

    Features are runs of 1 to ``longest`` words, hashed to ``buckets``. A bucket's gain is the rounded-down logarithm of
    how much more often ``target`` has it; a document's weight adds up its features' gains, its score adds
    noise that depends on seed and id only, so that taking the highest scores draws without replacement by
    weight. Of the N rows with at least ``least_words`` words, floor(percent * N / 100) are drawn, ties to the smaller id.

    A null text has no words, and weight 0. Rows with a null id get a null score, are no part of N and are not drawn.
    A repeated row keeps its repeats, each with a rank of its own if drawn. Empty tables give an empty result
    (or gains against no target at all). Only text and id are read, so further columns cannot clash.
    """
    gain = gains(documents, target, text_col, longest, buckets)
    rows = stored(weigh(documents, gain, longest, id_col, text_col), "resample-weights")
    rows = rows.withColumn("score", F.col("weight") + noise("doc_id", seed))
    able = rows.where((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull())
    drawn = able.count() * percent // 100
    ranked = numbered(able, [F.col("score").desc(), F.col("doc_id").asc()], "rank")
    rest = rows.where(~F.coalesce((F.col("n_words") >= least_words) & F.col("doc_id").isNotNull(), F.lit(False)))
    out = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).unionByName(
        rest.withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


ORACLE = r"""
WITH RECURSIVE digit(n, v, step) AS (
  SELECT CAST(range AS BIGINT), CAST(range AS BIGINT), 0 FROM range(256)
  UNION ALL
  SELECT n, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM digit WHERE step < 8
), crc AS (SELECT list(v ORDER BY n) AS t FROM digit WHERE step = 8
), words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL
), bytes AS (
  SELECT word, list_transform(regexp_extract_all(hex(encode(word)), '..'),
    lambda b: CAST(('0x' || b) AS BIGINT)) AS b FROM (SELECT DISTINCT word FROM counted)
), hashed AS (
  SELECT word, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM bytes, crc
), buckets AS (
  SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS BIGINT) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS BIGINT) AS t
  FROM counted JOIN hashed USING (word) GROUP BY bucket
), total AS (SELECT CAST(sum(s) AS BIGINT) AS s_all, CAST(sum(t) AS BIGINT) AS t_all FROM buckets
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS g
  FROM buckets, total
), weight AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * g) AS BIGINT) AS weight
  FROM counted JOIN hashed USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000.0 * ln(-ln(
      (CAST(('0x' || substr(sha256('2024:' || d.doc_id), 1, 8)) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weight w ON d.doc_id = w.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank,
  n_features AS n_words FROM placed
"""
