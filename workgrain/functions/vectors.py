"""Vector encoding and exact cosine similarity on Arrow batches."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_encoder(texts: Sequence[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed bag of hashed words: the stand-in for a neural model kept elsewhere."""
    out = np.zeros((len(texts), dimensions), dtype=np.float64)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            code = zlib.crc32(word.encode())
            out[row, (code >> 1) % dimensions] += 1.0 if code & 1 else -1.0
    return out


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; an all-zero row becomes the first unit vector."""
    matrix = np.array(matrix, dtype=np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    matrix[norms == 0, 0] = 1.0
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def encode_text(text: Column, encoder: Encoder = hashing_encoder, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of a text. A wrong vector count or size fails the batch."""

    @F.arrow_udf("array<float>")
    def encode(batch: pa.Array) -> pa.Array:
        texts = ["" if t is None else t for t in batch.to_pylist()]
        if not texts:
            return pa.array([], pa.list_(pa.float32()))
        vectors = np.asarray(encoder(texts))
        if vectors.shape != (len(texts), dimensions):
            raise ValueError(f"expected {len(texts)} vectors of {dimensions}, got {vectors.shape}")
        flat = unit_rows(vectors).astype(np.float32).ravel()
        offsets = np.arange(0, flat.size + 1, dimensions, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode(text)


def cosine_similarity(vector: Column, query: Sequence[float]) -> Column:
    """1 − cosine distance to a fixed query; null for null, zero or odd-sized vectors."""
    q = np.asarray(query, dtype=np.float64)
    q = q / np.linalg.norm(q)

    @F.arrow_udf("double")
    def similarity(batch: pa.Array) -> pa.Array:
        lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        fits = lengths == q.size
        kept = batch.filter(pa.array(fits))
        rows = kept.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, q.size)
        norms = np.linalg.norm(rows, axis=1)
        out = np.full(len(batch), np.nan)
        out[fits] = (rows @ q) / np.where(norms == 0, np.nan, norms)
        return pa.array(out, mask=np.isnan(out))

    return similarity(vector)
