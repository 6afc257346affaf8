"""Near copies among vectors: binary codes of randomly rotated vectors decide which pairs are computed exactly."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, stored
from .topk import matrix, usable

BLOCK = 2048
SEED = 20
PAIRS = 1 << 15
CONFIDENCE = 4.0
ROUNDING = 1e-9


@lru_cache(maxsize=8)
def rotation(dimensions: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated unit vectors and the correction factor: inner product of a vector with its code."""
    turned = unit(vectors) @ rotation(vectors.shape[1]).T
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def decode(codes: np.ndarray, dimensions: int) -> np.ndarray:
    """Codes as unit vectors of ±1/sqrt(d)."""
    bits = np.unpackbits(codes, axis=1)[:, :dimensions].astype(np.float32)
    return (2 * bits - 1) / np.float32(np.sqrt(dimensions))


def estimates(codes: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(estimate, confidence, most) of the inner product of each coded vector with each rotated unit vector.

    A vector o with code x and factor f = <o, x> is f·x plus a rest of length sqrt(1−f²) at right angles to x,
    so <o, q> = f·s + rest with s = <x, q>. Over random rotations s/f is an unbiased estimate of <o, q>, off by about
    sqrt(1−f²)/f/sqrt(d−1); the confidence is CONFIDENCE times that. ``most`` is a bound that holds with certainty, by
    |rest| <= sqrt(1−f²)·sqrt(1−s²).
    """
    s = np.clip(decode(codes, turned.shape[1]) @ turned.T.astype(np.float32), -1, 1)
    f = factor[:, None].astype(np.float32)
    rest = np.sqrt(np.maximum(0, 1 - f * f))
    return s / f, CONFIDENCE * rest / f / np.sqrt(max(1, turned.shape[1] - 1)), f * s + rest * np.sqrt(1 - s * s)


def linking(u: np.ndarray, rows: np.ndarray, second: np.ndarray, chosen: np.ndarray, least: float) -> np.ndarray:
    """Those of the chosen pairs (a mask, rows by second) whose cosine in double precision is at least ``least``.

    Each pair is decided by its own inner product, however many are chosen: a product of whole blocks only picks
    those that are not within rounding of the threshold.
    """
    found = []
    if chosen.mean() > 0.02:
        cosine = u[rows] @ u[second].T
        sure = chosen & (cosine >= least + ROUNDING)
        a, b = np.nonzero(sure)
        found.append(np.stack([rows[a], second[b]], axis=1))
        chosen = chosen & (np.abs(cosine - least) < ROUNDING)
    a, b = np.nonzero(chosen)
    for i in range(0, len(a), PAIRS):
        x, y = rows[a[i : i + PAIRS]], second[b[i : i + PAIRS]]
        near = np.einsum("ij,ij->i", u[x], u[y]) >= least
        found.append(np.stack([x[near], y[near]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def links_of_block(vectors: np.ndarray, codes: np.ndarray, factor: np.ndarray, first: np.ndarray, second: np.ndarray,
                   least: float, told: dict | None = None) -> np.ndarray:
    """Row pairs (a in first, b in second, each pair once) with cosine >= least.

    The estimate settles which pairs are computed: those whose confidence interval reaches the threshold. Pairs whose
    interval lies below it go, unless the certain bound says that they could still link: then they are
    computed as well, so that none is lost. ``told`` gets the numbers of pairs, of those that the estimate picks, of
    those that the bound adds, and the links found among either.
    """
    u = unit(vectors)
    turned = u @ rotation(vectors.shape[1]).T
    found = []
    same = first is second
    for at in range(0, len(first), 512):
        rows = first[at : at + 512]
        estimate, confidence, most = estimates(codes[rows], factor[rows], turned[second])
        all_pairs = second[None, :] > rows[:, None] if same else np.ones(estimate.shape, dtype=bool)
        picked = all_pairs & (estimate + confidence >= least)
        added = all_pairs & ~picked & (most >= least - 1e-4)
        parts = [linking(u, rows, second, chosen, least) for chosen in (picked, added)]
        found += parts
        if told is not None:
            for name, n in (("pairs", all_pairs.sum()), ("picked", picked.sum()), ("added", added.sum()),
                            ("links_picked", len(parts[0])), ("links_added", len(parts[1]))):
                told[name] = told.get(name, 0) + int(n)
    return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each of n rows."""
    label = np.arange(n)
    while len(pairs):
        before = label.copy()
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        np.minimum.at(label, pairs[:, 0], low)
        np.minimum.at(label, pairs[:, 1], low)
        label = label[label]
        if (label == before).all():
            break
    return label


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept.

    Rows link when their labels are equal and not null, their vectors equally long and the cosine in double
    precision at least ``least``. Vectors that are null, empty, zero, or hold null or non-finite components link
    with nothing. component_id is the smallest id reachable by links, itself included; kept says that the
    row is that one. A repeated row counts as another row. A row with a null id takes part and is never kept.

    Equal vectors of a label become one node with a count before anything is compared. Nodes of a label meet in
    tiles of at most 2 * ``BLOCK`` rows, however large the label is; a tile sends on link counts and one edge
    for each node, never its pairs.
    """
    live = usable(vector_col) & F.exists(vector_col, lambda x: x != 0) & F.col(label_col).isNotNull()
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"),
                          F.when(live, F.xxhash64(label_col, vector_col)).alias("node"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("smallest"), F.first("label").alias("label"),
        F.first("v").alias("v"))

    def code(batches):
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy()
            for d in np.unique(sizes):
                part = batch.filter(pa.array(sizes == d))
                codes, factor = encode(matrix(pa.chunked_array([part.column("v")])))
                out = {n: part.column(n) for n in batch.schema.names}
                yield pa.record_batch(out | {
                    "d": pa.array([int(d)] * part.num_rows, pa.int32()),
                    "code": pa.array([c.tobytes() for c in codes], pa.binary()), "factor": pa.array(factor)})

    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    coded = stored(nodes.mapInArrow(
        code, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", d int, code binary, factor double"), "codes")
    sizes = coded.groupBy("label", "d").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    tiles = (
        coded.select("label", "d", "node", "copies", "v", "code", "factor").join(sizes, ["label", "d"])
        .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
        .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "with")).withColumn("j", F.greatest("block", "with")))

    def compare(table: pa.Table) -> pa.Table:
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first = np.flatnonzero(block == i)
        second = first if i == j else np.flatnonzero(block == j)
        codes = np.stack([np.frombuffer(c.as_py(), np.uint8) for c in table.column("code")])
        pairs = links_of_block(matrix(table.column("v")), codes, table.column("factor").to_numpy(), first, second, least)
        n = np.zeros(len(node), dtype=np.int64)
        np.add.at(n, pairs[:, 0], copies[pairs[:, 1]])
        np.add.at(n, pairs[:, 1], copies[pairs[:, 0]])
        root = roots(len(node), pairs)
        some = np.flatnonzero(n)
        return pa.table({"a": node[some], "b": node[root[some]], "n": n[some]})

    found = stored(tiles.groupBy("label", "d", "i", "j").applyInArrow(compare, "a long, b long, n long"), "code-links")
    linked = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(found.select("a", "b"))
    labels = (
        coded.select("node", "copies", "smallest").join(linked, "node", "left").join(joined, "node", "left")
        .select("node", "smallest", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                F.coalesce("component", "node").alias("component")))
    names = labels.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = labels.join(names, "component").select("node", "n_links", "component_id")
    own = F.col("node").isNull()
    out = rows.select("vec_id", "node").join(named, "node", "left").select(
        "vec_id", F.when(own, F.lit(0).cast("long")).otherwise(F.col("n_links")).alias("n_links"),
        F.when(own, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN component USING (vec_id)
"""
