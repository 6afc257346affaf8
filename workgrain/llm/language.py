"""Language identification: family first, then one-versus-one linear SVMs inside the family."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import class_sample, slices

#: Families of closely related languages by code. A language not named here is a family of its own.
FAMILIES = {
    "da": "germanic", "de": "germanic", "en": "germanic", "nl": "germanic", "no": "germanic", "sv": "germanic",
    "ca": "romance", "es": "romance", "fr": "romance", "it": "romance", "pt": "romance", "ro": "romance",
    "bg": "slavic", "cs": "slavic", "pl": "slavic", "ru": "slavic", "sk": "slavic", "uk": "slavic",
}
UNKNOWN = "und"
BITS = 13
SLICE = 1 << 20
LETTER = regex.compile(r"\p{L}")


def gram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of hashed one-, two- and three-character grams of the whole lower-cased text, in bounded slices."""
    counts = np.zeros(1 << bits, dtype=np.int64)
    first = True
    for part in slices(text.lower(), SLICE, 2):
        c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA6B)
        triples = pairs[:-1] * np.uint32(0xC2B2AE35) + c[2:] * np.uint32(0x27D4EB2F)
        own = 0 if first else 2  # the overlap was counted with the slice before
        grams = (c[own:] * np.uint32(0x165667B1), pairs[max(0, own - 1):], triples)
        for codes in grams:
            counts += np.bincount((codes ^ (codes >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits),
                                  minlength=1 << bits)
        first = False
    return counts


def unit(counts: np.ndarray) -> np.ndarray:
    """Square roots of the counts scaled to length one."""
    x = np.sqrt(counts).astype(np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (last one the bias) of a squared-hinge linear SVM by dual coordinate descent; y is ±1."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=np.float32)])
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = {s: len(y) / (2 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    slack = np.array([1 / (2 * cost * share[int(s)]) for s in y])
    norm, order = (x * x).sum(axis=1) + slack, np.random.default_rng(7)
    for _ in range(rounds):
        for i in order.permutation(len(x)):
            step = (y[i] * (x[i] @ w) - 1 + slack[i] * alpha[i]) / norm[i]
            new = max(0.0, alpha[i] - step)
            w += (new - alpha[i]) * y[i] * x[i]
            alpha[i] = new
    return w


@dataclass
class LanguageModel:
    """Pairs of families and pairs of languages, one weight column each; margins become odds by ``slope``."""

    languages: list[str] = field(default_factory=list)
    families: dict[str, str] = field(default_factory=dict)
    pairs: list[tuple[str, str]] = field(default_factory=list)
    weights: np.ndarray | None = None
    slope: float = 6.0

    def duel(self, names: list[str], margin: dict[tuple[str, str], float]) -> tuple[str, float]:
        """The name that wins most pairs (ties: larger summed margin, then name) and its weakest odds."""
        if len(names) == 1:
            return names[0], 1.0
        won = {n: [0, 0.0, 1.0] for n in names}
        for a, b in combinations(names, 2):
            m = margin[a, b]
            for n, s in ((a, m), (b, -m)):
                own = won[n]
                own[0] += s > 0
                own[1] += s
                own[2] = min(own[2], 1 / (1 + np.exp(-self.slope * np.clip(s, -20, 20))))
        best = min(names, key=lambda n: (-won[n][0], -won[n][1], n))
        return best, float(won[best][2])

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        margins = {}
        if self.pairs:
            x = unit(gram_counts(text))
            margins = dict(zip(self.pairs, x @ self.weights[:-1] + self.weights[-1], strict=True))
        family, sure = self.duel(sorted(set(self.families.values())), margins)
        language, own = self.duel([n for n in self.languages if self.families[n] == family], margins)
        return language, sure * own


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id",
          per_language: int = 400, families: dict[str, str] = FAMILIES) -> LanguageModel:
    """Fit on about ``per_language`` rows of each language, drawn by a hash of the key.

    Rows with a null language, a null text or a text without letters teach nothing. Grams are counted
    in Spark tasks; the driver sees at most 2^13 counts for each sampled row. Without any row the model
    knows no language and answers ``und``; with one language it always answers that one.
    """
    known = docs.select(F.col(key_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    known = known.where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))

    def count(batches):
        for batch in batches:
            rows = [gram_counts(t) for t in batch.column("t").to_pylist()]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.record_batch({
                "l": batch.column("l"), "k": batch.column("k"),
                "at": pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                "n": pa.array([r[a].astype(np.int32) for r, a in zip(rows, at, strict=True)], pa.list_(pa.int32())),
            })

    sample = class_sample(known.select(F.xxhash64("k", F.crc32("t")).alias("k"), "t", "l"), "l", "k", per_language)
    got = sample.mapInArrow(count, "l string, k long, at array<int>, n array<int>").orderBy("l", "k").toArrow()
    if not got.num_rows:
        return LanguageModel()
    labels = got.column("l").to_pylist()
    x = np.zeros((got.num_rows, 1 << BITS), dtype=np.float32)
    for row, (at, n) in enumerate(zip(got.column("at"), got.column("n"), strict=True)):
        counts = np.zeros(1 << BITS)
        counts[at.values.to_numpy()] = n.values.to_numpy()
        x[row] = unit(counts)
    languages = sorted(set(labels))
    model = LanguageModel(languages, {n: families.get(n, n) for n in languages})
    kin = np.array([model.families[n] for n in labels])
    names = np.array(labels)
    columns = []
    for a, b in combinations(sorted(set(kin)), 2):
        mine = (kin == a) | (kin == b)
        model.pairs.append((a, b))
        columns.append(linear_svm(x[mine], np.where(kin[mine] == a, 1, -1)))
    for a, b in combinations(languages, 2):
        if model.families[a] == model.families[b]:
            mine = (names == a) | (names == b)
            model.pairs.append((a, b))
            columns.append(linear_svm(x[mine], np.where(names[mine] == a, 1, -1)))
    model.weights = np.array(columns, dtype=np.float32).T if columns else None
    return model


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred`` and ``score``; columns of these names are replaced.

    A null text, an empty one and one without a letter get ``und`` and 0. Repeated rows stay as they are.
    Texts of any length are read whole, in bounded slices.
    """

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            ["lang", "score"])

    told = F.col("__told")
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, predict(F.col(text_col)).alias("__told")).select(
        *kept, told["lang"].alias("lang_pred"), told["score"].alias("score"))
