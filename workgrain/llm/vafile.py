"""Lloyd's clustering over a vector-approximation file: few-bit cells bound distances, full vectors settle the rest.

Every vector is kept twice: as cell numbers of a few bits per dimension, and in full. A round reads the cells only. For each
centroid a table has the least and the most that a cell of a dimension can add to the squared distance; their sums over the
dimensions are an interval that holds the exact distance, less the distance to the centroid that the cells' middles suggest. A vector
for which all other intervals begin above that one's is assigned by the cells alone; only vectors with overlapping intervals, and vectors that change their cluster (their components move from one sum
to another), are fetched in full by a join on their row number. All arithmetic is on integers, so nothing depends on order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .topk import usable

BITS = 6
TAIL = 0.005  # share of the components on either side that the two outer cells of a dimension take
LARGEST = 1 << 26  # beyond it squared distances and their sums would leave 64 bits


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate(flat or [np.zeros(0, np.int64)]).reshape(-1, width)


def edges_of(vectors: DataFrame, width: int, bits: int) -> np.ndarray:
    """Cell edges [dimension, cells + 1]: least and greatest component outside, even steps between two quantiles inside.

    The quantiles are approximate; they only decide how narrow the cells are, never what a bound holds.
    """
    sums = vectors.agg(*(e for i in range(width) for e in (
        F.min(F.col("v")[i]), F.max(F.col("v")[i]), F.percentile_approx(F.col("v")[i], [TAIL, 1 - TAIL], 1000)))).first()
    out = np.zeros((width, (1 << bits) + 1), dtype=np.int64)
    for i in range(width):
        low, high, (first, last) = sums[3 * i : 3 * i + 3]
        inner = np.floor(np.linspace(first, last + 1, (1 << bits) - 1)).astype(np.int64)
        out[i] = np.concatenate([[low], np.clip(inner, low, high + 1), [high + 1]])
    return out


def cells_of(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cell number of each component: cell c of a dimension holds edges[c] <= x < edges[c + 1]."""
    return np.stack([np.searchsorted(edges[i, 1:-1], v[:, i], side="right") for i in range(v.shape[1])], axis=1).astype(np.uint8)


def packed(cells: np.ndarray, bits: int) -> list[bytes]:
    """Rows of cell numbers, ``bits`` bits each."""
    wide = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :]
    return [row.tobytes() for row in np.packbits(wide.reshape(len(cells), -1), axis=1)]


def unpacked(codes: pa.Array, width: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    wide = np.unpackbits(raw, axis=1)[:, : width * bits].reshape(len(codes), width, bits)
    return np.packbits(np.concatenate([np.zeros((len(codes), width, 8 - bits), np.uint8), wide], axis=2), axis=2)[:, :, 0]


def lookup(centroids: np.ndarray, edges: np.ndarray, reference: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) [centroid, dimension, cell]: what a component of the cell can add to the squared distance.

    The distance to a reference centroid is taken off everywhere: intervals compare as before, and what is left is
    linear in the component, so it is least and most at the ends of the cell.
    """
    low, high = edges[None, :, :-1], np.maximum(edges[None, :, 1:] - 1, edges[None, :, :-1])
    c, r = centroids[:, :, None], centroids[reference][None, :, None]
    at_low, at_high = ((x - c) ** 2 - (x - r) ** 2 for x in (low, high))
    return np.minimum(at_low, at_high), np.maximum(at_low, at_high)


def intervals(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) [row, centroid] of the squared distances less the one to the reference."""
    dims = np.arange(cells.shape[1])
    return tuple(np.stack([t[dims[None, :], cells].sum(axis=1) for t in table], axis=1) for table in tables)


def likely(cells: np.ndarray, centroids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The centroid nearest to the middle of each row's cells."""
    middle = ((edges[:, :-1] + edges[:, 1:] - 1) // 2)[np.arange(cells.shape[1])[None, :], cells]
    return nearest(middle, centroids)[0]


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; ties go to the smaller number."""
    d = np.stack([((v - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    best = d.argmin(axis=1)
    return best, d[np.arange(len(v)), best]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: float = 1024.0, seed: int = 3,
            bits: int = BITS, id_col: str = "vec_id", vector_col: str = "embedding", told: list | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part.

    A vector takes part if it has exactly ``width`` components, none null or non-finite, and none of which
    floor(scale * x) passes 2^26 in size (squared distances would leave 64 bits). Centroids start as the k vectors
    with smallest sha256 of 'seed:id', in that order (a null id never starts one; of rows with one id the one with the smallest
    vector comes first; fewer than k give fewer centroids). Ties go to the smaller number, empty clusters stay where they are.
    Repeated rows count each time. An empty table, or one without any usable id, gives an empty result. Only id
    and vector are read, so further columns cannot clash.

    The driver holds k centroids and the cell edges of ``width`` dimensions, whatever the number of vectors. ``told``
    gets, for each round, how many vectors the intervals alone assigned and how many were fetched in full.
    """
    x = F.transform(vector_col, lambda e: F.floor(F.lit(scale) * e.cast("double")))
    rows = vectors.where(usable(vector_col) & (F.size(vector_col) == width)).select(
        F.col(id_col).alias("vec_id"), x.alias("v")).where(~F.exists("v", lambda e: F.abs(e) > LARGEST))
    full = stored(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("v").cast("array<long>").alias("v")), "va-vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = full.where("vec_id IS NOT NULL").select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    kind = rows.schema["vec_id"].dataType.simpleString()
    if not first:
        return full.limit(0).selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256")
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    edges = edges_of(full, width, bits)

    def approximate(batches):
        for batch in batches:
            if batch.num_rows:
                codes = packed(cells_of(matrix(batch.column("v"), width), edges), bits)
                yield pa.record_batch({"row": batch.column("row"), "codes": pa.array(codes, pa.binary())})

    none = F.lit(None).cast("int").alias("cluster")
    state = stored(full.select("row", "v").mapInArrow(approximate, "row long, codes binary").select("*", none), "va-codes")
    sums, sizes = np.zeros((len(centroids), width), dtype=object), np.zeros(len(centroids), dtype=object)
    for _ in range(rounds):
        state, moved = _round(state, full, centroids, edges, width, bits, told)
        for r in moved:
            sizes[r["cluster"]] += r["n"]
            sums[r["cluster"]] += np.array(r["sums"], dtype=object)
        for c in range(len(centroids)):
            if sizes[c]:
                centroids[c] = np.array([int(s) // int(sizes[c]) for s in sums[c]], dtype=np.int64)
    state, _ = _round(state, full, centroids, edges, width, bits, told)

    def distances(batches):
        for batch in batches:
            if batch.num_rows:
                v, c = matrix(batch.column("v"), width), batch.column("cluster").to_numpy()
                d = ((v - centroids[c]) ** 2).sum(axis=1)
                yield pa.record_batch({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": pa.array(d, pa.int64())})

    out = stored(full.join(state.select("row", "cluster"), "row").select("vec_id", "v", "cluster").mapInArrow(
        distances, f"vec_id {kind}, cluster int, distance long"), "va-distances")
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    about = [(c, inertia.get(c, 0), sum(inertia.values()), h) for c, h in enumerate(hashes)]
    names = vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(names), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(state: DataFrame, full: DataFrame, centroids: np.ndarray, edges: np.ndarray, width: int, bits: int, told: list | None):
    """(state with the new clusters, rows cluster, n, sums of what came minus what went)."""
    k = len(centroids)

    def by_cells(batches):
        tables = [lookup(centroids, edges, r) for r in range(k)]
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = unpacked(batch.column("codes"), width, bits)
            best, sure = likely(cells, centroids, edges), np.zeros(batch.num_rows, dtype=bool)
            for r in np.unique(best):  # its own interval is 0 to 0: sure if all others begin above
                mine = np.flatnonzero(best == r)
                sure[mine] = (np.delete(intervals(cells[mine], tables[r])[0], r, axis=1) > 0).all(axis=1)
            yield pa.record_batch({
                "row": batch.column("row"), "codes": batch.column("codes"), "old": batch.column("cluster"),
                "new": pa.array(best.astype(np.int32), mask=~sure)})

    seen = stored(state.mapInArrow(by_cells, "row long, codes binary, old int, new int"), "va-round")
    wanted = seen.where("new IS NULL OR NOT new <=> old")

    def settle(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), width)
            known = batch.column("new").is_valid().to_numpy(zero_copy_only=False)
            new = batch.column("new").fill_null(0).to_numpy().copy()
            if not known.all():
                new[~known] = nearest(v[~known], centroids)[0]
            yield pa.record_batch({"row": batch.column("row"), "old": batch.column("old"), "now": pa.array(new, pa.int32()), "v": batch.column("v")})

    settled = stored(wanted.select("row", "old", "new").join(full.select("row", "v"), "row").mapInArrow(
        settle, "row long, old int, now int, v array<long>"), "va-settled")
    if told is not None:
        told.append((seen.where("new IS NOT NULL").count(), wanted.count()))

    def change(batches):
        total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), width)
            for name, sign in (("now", 1), ("old", -1)):
                there = batch.column(name).is_valid().to_numpy(zero_copy_only=False)
                c = batch.column(name).fill_null(0).to_numpy()[there]
                np.add.at(total, c, sign * v[there])
                np.add.at(n, c, sign)
        touched = np.flatnonzero((n != 0) | total.any(axis=1))
        yield pa.record_batch({
            "cluster": pa.array(touched, pa.int32()), "n": pa.array(n[touched], pa.int64()),
            "sums": pa.array(total[touched].tolist(), pa.list_(pa.int64()))})

    parts = settled.where("NOT now <=> old").mapInArrow(change, "cluster int, n long, sums array<long>")
    added = parts.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width))).alias("sums"))
    now = seen.join(settled.select("row", "now"), "row", "left").select("row", "codes", F.coalesce("now", "new").alias("cluster"))
    return now, added.collect()


def oracle(k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """DuckDB twin: one row per vector and dimension, one pair of steps for each round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT v.vec_id, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} c USING (i) GROUP BY ALL)
  GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n + n) % n)) // n AS BIGINT) END AS x FROM c{r} c LEFT JOIN (
    SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v USING (vec_id) GROUP BY ALL) m ON c.k = m.k AND c.i = m.i)""")
    return f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {width + 1})) AS i, unnest(w) AS x FROM kept
), c0 AS MATERIALIZED (
  SELECT k, unnest(range(1, {width + 1})) AS i, unnest(w) AS x FROM (
    SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, w FROM kept) WHERE k < {k}
), {', '.join(steps)}, names AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k
)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN names USING (k)
"""
