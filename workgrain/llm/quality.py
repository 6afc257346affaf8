"""Quality score from compressed sizes under dictionaries of good and of bad text."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

PIECE = 4096
LEVEL = 3
SMOOTH = 64
PLAIN = 0.25


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Frames without headers that would weigh on short texts."""
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def packed_size(squeeze: zstandard.ZstdCompressor, data: bytes) -> int:
    """Compressed size of the whole text, piece by piece, so the dictionary counts for every piece."""
    return sum(len(squeeze.compress(data[i : i + PIECE])) for i in range(0, len(data), PIECE))


def build_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained zstandard dictionary; too little text for training is used as it is."""
    pieces = [t[i : i + PIECE] for t in texts for i in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:]


def own_lines(sample: list[tuple[int, bytes]]) -> dict[int, list[bytes]]:
    """Texts by label without the lines that several sampled texts share: copied passages say nothing of quality.

    A label that would be left without lines keeps each line of its own once, and if the other label
    has all of them too, its texts whole, each once.
    """
    cut = [(y, t.split(b"\n")) for y, t in sample]
    seen = Counter(line for _, lines in cut for line in set(lines))
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for y, lines in cut:
        if text := b"\n".join(line for line in lines if seen[line] == 1):
            out[y].append(text)
    for label in out:
        if not out[label]:
            others = {line for y, lines in cut if y != label for line in lines}
            own = dict.fromkeys(line for y, lines in cut if y == label for line in lines if line and line not in others)
            out[label] = list(own) or list(dict.fromkeys(t for y, t in sample if y == label))
    return out


def measures(good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor, text: str | None) -> list[float]:
    """Normalised size difference and shortfall of one text, both 0 for no text.

    Difference: (size under bad − size under good) / (sum of both + SMOOTH), higher for better text; the
    constant keeps a few known sentences in a short text from deciding alone. Shortfall: logarithm of
    (sum of both) / (2 * length) below PLAIN, 0 above: text that repeats itself packs well either way.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return [0.0, 0.0]
    g, b = packed_size(good, data), packed_size(bad, data)
    return [(b - g) / (b + g + SMOOTH), min(0.0, float(np.log((b + g + SMOOTH) / (2 * len(data) * PLAIN))))]


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Log odds of label 1: weights of the measures (never negative) and offset, by damped Newton steps."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.hstack([x / scale, np.ones((len(x), 1))])
    w, used = np.zeros(z.shape[1]), np.ones(z.shape[1], dtype=bool)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p))[:, None]).T @ z + 1e-1 * np.eye(len(w))
        step = np.linalg.solve(hessian[np.ix_(used, used)], (z.T @ (y - p) - 1e-1 * w)[used])
        w[used] += np.clip(step, -2, 2)
        if (low := (w[:-1] < 0)).any():
            used[:-1] &= ~low
            w[:-1][low] = 0.0
    return w[:-1] / scale, float(w[-1])


@dataclass
class QualityModel:
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0, 0.0)
    offset: float = 0.0

    def score(self, values: list[float]) -> float:
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.weights, values) + self.offset, -30, 30))))


def measured(rows: DataFrame, model: QualityModel) -> DataFrame:
    def measure(batches):
        good, bad = compressor(model.good), compressor(model.bad)
        for batch in batches:
            values = [measures(good, bad, t.as_py()) for t in batch.column("t")]
            yield pa.record_batch({"y": batch.column("y"), "v": pa.array(values, pa.list_(pa.float64()))})

    return rows.select("y", "t").mapInArrow(measure, "y int, v array<double>")


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality",
          key_col: str = "doc_id", per_class: int = 400, calibration: int = 2000, piece_bytes: int = 16384,
          dictionary_bytes: int = 110_000) -> QualityModel:
    """Dictionaries from about ``per_class`` texts of each label, odds from about ``calibration`` other ones.

    Both samples are drawn by a hash of the key from the labels alone, so the joined side is bounded by these
    parameters and is broadcast: no text is shuffled. Of a dictionary text, ``piece_bytes`` spread over the
    whole text at most are used, so the driver's share is bounded too: 2 * per_class * piece_bytes. Labels
    that are null or neither 0 nor 1, and labels of a null or empty text, teach nothing; a key with
    several labels teaches each. Lines that several dictionary texts share are left out (``own_lines``), unless
    a label has no others. Without texts of both labels every score is the share of label 1 (0.5
    without labels).
    """
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(key_col).alias("k"), F.col(label_col).cast("int").alias("y"))
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    total = sum(shares.values())
    prior = (shares.get(1, 0) + 0.5) / (total + 1)
    model = QualityModel(offset=float(np.log(prior / (1 - prior))))
    if len(shares) < 2:
        return model
    draw = F.pmod(F.xxhash64("k", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    words = F.when(F.col("y") == 1, min(0.5, per_class / shares[1])).otherwise(min(0.5, per_class / shares[0]))
    use = F.when(draw < words, "dictionary").when(draw >= 1 - min(0.5, calibration / total), "odds")
    chosen = known.select("k", "y", use.alias("use")).where("use IS NOT NULL")
    texts = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    sample = stored(texts.join(F.broadcast(chosen), "k"), "quality-sample")

    def cut(batches):
        for batch in batches:
            out = []
            for t in batch.column("t"):
                data = t.as_py().encode("utf-8", "surrogatepass")
                n, most = -(-len(data) // PIECE), piece_bytes // PIECE
                spread = range(n) if n <= most else np.linspace(0, n - 1, most).astype(int)
                out.append(b"".join(data[i * PIECE : (i + 1) * PIECE] for i in spread))
            yield pa.record_batch({"y": batch.column("y"), "t": pa.array(out, pa.binary())})

    got = sample.where("use = 'dictionary'").select("y", "t").mapInArrow(cut, "y int, t binary").toArrow()
    pairs = sorted(zip(got.column("y").to_pylist(), got.column("t").to_pylist(), strict=True))
    lines = own_lines(pairs)
    if not lines[0] or not lines[1]:
        return model
    model.good, model.bad = (build_dictionary(lines[y], dictionary_bytes) for y in (1, 0))
    odds = measured(sample.where("use = 'odds'"), model).toArrow().to_pylist()
    odds.sort(key=lambda r: (r["y"], r["v"]))
    if len({r["y"] for r in odds}) == 2:
        model.weights, model.offset = calibrate(
            np.array([r["v"] for r in odds]), np.array([r["y"] for r in odds], dtype=float))
    return model


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """Every row with ``score`` (0 to 1) and ``predicted`` (1 from ``cut`` on); such columns are replaced.

    A null or empty text has measures 0. Texts of any length are compressed whole; repeated rows stay.
    """

    @F.arrow_udf("double")
    def measure(texts: pa.Array) -> pa.Array:
        good, bad = compressor(model.good), compressor(model.bad)
        return pa.array([model.score(measures(good, bad, t.as_py())) for t in texts], pa.float64())

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*kept, measure(F.col(text_col)).alias("__score")).select(
        *kept, F.col("__score").alias("score"), (F.col("__score") >= cut).cast("int").alias("predicted"))
