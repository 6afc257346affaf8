"""Exact top-k by integer inner product: columnar branch and bound over blocks of dimensions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

QUERY_BLOCK = 2048
CANDIDATE_BLOCK = 8192
DIMENSIONS = 16
ROWS_AT_ONCE = 256
NO_ID = np.iinfo(np.int64).max


def usable(vector_col: str):
    """Not null, not empty, every component present and finite."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & ~F.coalesce(bad, F.lit(True))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    flat = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in vectors.chunks]
    return np.concatenate(flat).reshape(len(vectors), -1)


def best_of_block(query: np.ndarray, candidate: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int):
    """(query row, candidate row, score) of each query's k best in the block, ties to the smaller id.

    Both sides lie dimension by dimension, those with most mass first. After each block of dimensions a
    candidate's score lies within (mass left in the query) * (mass left in the candidate) of what has been
    added up, by Cauchy-Schwarz; candidates whose upper bound is below the k-th best lower bound are dropped.
    While most candidates are alive whole columns are multiplied, after that only the compacted rest is.
    """
    order = np.argsort(-(candidate * candidate).sum(axis=0), kind="stable")
    query, columns = query[:, order], np.ascontiguousarray(candidate[:, order].T)
    edges = list(range(0, len(order), DIMENSIONS)) + [len(order)]
    left_c = np.sqrt(np.stack([(columns[e:] ** 2).sum(axis=0) for e in edges]))
    left_q = np.sqrt(np.stack([(query[:, e:] ** 2).sum(axis=1) for e in edges], axis=1))
    out = []
    for at in range(0, len(query), ROWS_AT_ONCE):
        q = query[at : at + ROWS_AT_ONCE]
        mine = own[at : at + ROWS_AT_ONCE, None] == ids[None, :]
        total = np.where(mine, -np.inf, 0.0)
        step = 1
        while step < len(edges):
            total += q[:, edges[step - 1] : edges[step]] @ columns[edges[step - 1] : edges[step]]
            slack = left_q[at : at + ROWS_AT_ONCE, step, None] * left_c[step] * (1 + 1e-9)
            floor = kth_largest(total - slack, k)
            alive = total + slack >= floor[:, None] - 1e-6
            step += 1
            if alive.mean() < 0.25:
                break
        for row in range(len(q)):
            live = np.flatnonzero(alive[row] & ~mine[row])
            score = total[row, live]
            for s in range(step, len(edges)):
                score = score + q[row, edges[s - 1] : edges[s]] @ columns[edges[s - 1] : edges[s], live]
                slack = left_q[at + row, s] * left_c[s, live] * (1 + 1e-9)
                keep = score + slack >= kth_largest((score - slack)[None], k)[0] - 1e-6
                live, score = live[keep], score[keep]
            best = np.lexsort((ids[live], -score))[:k]
            out.append((np.full(len(best), at + row), live[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def kth_largest(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] <= k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _dealt(rows: DataFrame, own: str, blocks: int, other: str, other_blocks: int) -> DataFrame:
    """Each row in its own block, once for each block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64("id", "mark", F.lit("block")), F.lit(blocks))).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)).cast("array<long>")))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of floor(scale * x) vectors for each query.

    Queries: rows whose id is divisible by ``every``; candidates: every row with another id. Vectors that are
    null, empty, or hold null or non-finite components take no part; vectors of different lengths are not
    compared. Fewer than k candidates are all returned; ties go to the smaller id, a null id comes last. A
    repeated candidate row takes a rank each time, a repeated query row (id and vector) is asked once. Scores
    are exact up to 2^53; a larger one is rounded to a double and kept within a long.

    Queries and candidates meet in tiles of bounded size; each tile sends on k rows for each of its queries at
    most. Only the two row counts reach the driver.
    """
    rows = vectors.where(usable(vector_col)).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(vector_col).alias("v"),
        F.xxhash64(vector_col).alias("mark"), F.size(vector_col).alias("d"))
    rows = stored(rows, "topk-vectors")
    asked = rows.where((F.col("id") % every == 0) & (F.col("id") != int(NO_ID))).dropDuplicates(["id", "mark"])
    n_asked, n_rows = asked.count(), rows.count()
    q_blocks, c_blocks = -(-n_asked // QUERY_BLOCK) or 1, -(-n_rows // CANDIDATE_BLOCK) or 1
    queries = _dealt(asked, "i", q_blocks, "j", c_blocks)
    candidates = _dealt(rows, "j", c_blocks, "i", q_blocks)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        q = c = at = s = np.zeros(0, dtype=np.int64)
        ids, own = right.column("id").to_numpy(), left.column("id").to_numpy()
        mark = left.column("mark").to_numpy()
        if left.num_rows and right.num_rows:
            x, y = (np.floor(scale * matrix(t.column("v"))) for t in (left, right))
            q, at, s = best_of_block(x, y, ids, own, k)
            s, c = np.clip(s, -(2.0**63), 2.0**63 - 1024).astype(np.int64), ids[at]
        return pa.table({"id": own[q] if len(q) else q, "mark": mark[q] if len(q) else q, "other": c, "score": s})

    best = queries.groupBy("d", "i", "j").cogroup(candidates.groupBy("d", "i", "j")).applyInArrow(
        search, "id long, mark long, other long, score long")
    order = Window.partitionBy("id", "mark").orderBy(F.desc("score"), "other")
    return (
        best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select(F.col("id").alias("query_id"), "rank",
                F.when(F.col("other") != int(NO_ID), F.col("other")).alias("vec_id"), "score"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
