"""SentencePiece encoding and decoding with forward states shared by words with a common prefix.

The model at hand is a BPE model. A Viterbi search that adds up its scores does not give its ids (scores are merge
ranks, not likelihoods), so the forward step differs in one point: a piece may follow another one only if the merge
rules leave the two apart when they stand alone. Merges never cross the end of a final piece, so a row of
pieces is the model's own answer exactly if every neighbouring two are left apart; each prefix of a word then
has one last piece, and that piece is its forward state. Extending a prefix needs only the states before it, which
is what words with a common prefix share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

MARK = "▁"
CHARACTERS_AT_ONCE = 1 << 20
WORDS_KEPT = 150_000
LONGEST_KEPT = 48
NEVER = float("-inf")


class Pieces:
    """Vocabulary of a BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.id_of = {model.id_to_piece(i): i for i in plain}
        self.text_of = [model.id_to_piece(i) for i in ids]
        self.score = [model.get_score(i) for i in ids]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.raw = [b""] * len(ids)
        for i in plain:
            self.raw[i] = self.text_of[i].replace(MARK, " ").encode()
        for byte, i in self.byte_id.items():
            self.raw[i] = bytes([byte])
        self.apart: dict[tuple[int, int], bool] = {}
        self.traces: dict[int, tuple[list[float], list[str], list[str], bool]] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self._build_suffixes()

    def _build_suffixes(self) -> None:
        """Automaton over the pieces: each state is the longest piece prefix that a text ends with."""
        prefixes = {""} | {p[:n] for p in self.id_of for n in range(1, len(p) + 1)}
        order = sorted(prefixes, key=len)
        number = {p: i for i, p in enumerate(order)}
        self.step: list[dict[str, int]] = [{} for _ in order]
        self.fail = [0] * len(order)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(order)
        for p in order[1:]:
            me, parent = number[p], number[p[:-1]]
            self.step[parent][p[-1]] = me
            if len(p) > 1:
                at = self.fail[parent]
                while at and p[-1] not in self.step[at]:
                    at = self.fail[at]
                self.fail[me] = self.step[at].get(p[-1], 0)
            own = ((len(p), self.id_of[p]),) if p in self.id_of else ()
            self.ends[me] = own + self.ends[self.fail[me]]

    def trace(self, piece: int) -> tuple[list[float], list[str], list[str], bool]:
        """Merges of a piece's own text, best score first, then leftmost: their scores, the leftmost and the
        rightmost part before the first merge and after each, and whether they end in the piece itself."""
        if piece in self.traces:
            return self.traces[piece]
        parts = list(self.text_of[piece])
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            joint = [self.score[i] if (i := self.id_of.get(a + b)) is not None else NEVER for a, b in pairwise(parts)]
            best = max(joint)
            if best == NEVER:
                break
            at = joint.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        self.traces[piece] = scores + [NEVER], firsts, lasts, len(parts) == 1
        return self.traces[piece]

    def left_apart(self, one: int, two: int) -> bool:
        """Whether the merge rules give exactly these two pieces for their joined text; one < 0: the second alone.

        Merges inside the two run in their own order; the better next one goes first. The two are not left
        apart if, on the way, the parts that touch make a piece that is better than both next merges.
        """
        scores2, firsts, _, whole = self.trace(two)
        if one >= 0:
            scores1, _, lasts, whole1 = self.trace(one)
            whole &= whole1
            i = j = 0
            while whole:
                across = self.id_of.get(lasts[i] + firsts[j])
                if across is not None and self.score[across] > scores1[i] and self.score[across] >= scores2[j]:
                    whole = False
                elif scores1[i] == scores2[j] == NEVER:
                    break
                elif scores1[i] >= scores2[j]:
                    i += 1
                else:
                    j += 1
        self.apart[one, two] = whole
        return whole

    def encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Ids of words in sorted order: a depth-first walk of their trie that keeps the states of the current path."""
        apart, step, fail, ends = self.apart, self.step, self.fail, self.ends
        state, last, back = [0], [-1], [0]
        current = ""
        for word in words:
            shared, most = 0, min(len(word), len(current))
            if word[:most] == current[:most]:
                shared = most
            else:
                while word[shared] == current[shared]:
                    shared += 1
            del state[shared + 1 :], last[shared + 1 :], back[shared + 1 :]
            at = state[shared]
            for i in range(shared, len(word)):
                ch = word[i]
                while at and ch not in step[at]:
                    at = fail[at]
                at = step[at].get(ch, 0)
                for length, piece in ends[at]:
                    start = i + 1 - length
                    one = last[start]
                    ok = apart.get((one, piece)) if one > -2 else True
                    if self.left_apart(one, piece) if ok is None else ok:
                        last.append(piece)
                        back.append(start)
                        break
                else:  # a character without a piece: its bytes, and nothing merges across it
                    last.append(-2 - ord(ch))
                    back.append(i)
                state.append(at)
            current = word
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i = back[i]
            yield word, tuple(out[::-1]) if not out or min(out) >= 0 else tuple(self._spelled(out[::-1]))

    def _spelled(self, states: list[int]) -> Iterator[int]:
        for s in states:
            if s >= 0:
                yield s
            else:
                yield from (self.byte_id[b] for b in chr(-2 - s).encode("utf-8", "surrogatepass"))

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; words met before are looked up, new ones are sorted and walked together."""
        split = [marked_words(t) for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        here = dict(self.encode_sorted(sorted(new)))
        if len(self.known) + len(here) > WORDS_KEPT:
            here.update((w, self.known[w]) for w in set(chain.from_iterable(split)) if w in self.known)
            self.known = {}
        self.known.update((w, i) for w, i in here.items() if len(w) <= LONGEST_KEPT)
        look = {**self.known, **here} if len(here) > len(new) or any(len(w) > LONGEST_KEPT for w in here) else self.known
        return [np.fromiter(chain.from_iterable(map(look.__getitem__, words)), dtype=np.int32) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: bytes are joined, marks become spaces, the one in front goes."""
        data = b"".join([self.raw[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def marked_words(text: str) -> list[str]:
    """Words with the mark of the space before them; joined they give the marked text.

    No piece has a mark behind another character and none holds a line feed, so the ids of a text are those of
    its words one after the other.
    """
    if not text:
        return []
    out: list[str] = []
    for number, line in enumerate(text.split("\n")):
        if number:
            out.append("\n")
        words = line.split(" ")
        if "" in words or MARK in line:
            out += _RUNS.findall(MARK * (not number) + line.replace(" ", MARK))
        else:
            out.append(words[0] if number else MARK + words[0])
            out += [MARK + w for w in words[1:]]
    return out


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


def encode_batch(texts: pa.Array, path: str) -> pa.Array:
    """Ids of texts as the model gives them; null for a null text, no ids for an empty one."""
    pieces, out, held, size = load(path), [], [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= CHARACTERS_AT_ONCE or i + 1 == len(texts):
            out += pieces.encode_texts(held)
            held, size = [], 0
    ends = np.cumsum([0, *map(len, out)]).astype(np.int32)
    flat = pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), flat, mask=texts.is_null())


def decode_batch(ids: pa.Array, path: str) -> pa.Array:
    """Texts of ids; null for null."""
    pieces = load(path)
    return pa.array([pieces.decode(i.values.to_numpy()) if i.is_valid else None for i in ids], pa.string())


def parts(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut into smaller ones, so that a task holds little more than one at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """Every row with ``ids``; a column of that name is replaced. Repeated rows stay.

    Rows pass through the tasks whole: a column expression would be computed again for each use of ``ids``.
    """
    kept, path = docs.drop("ids"), path or default_model()

    def run(batches):
        for batch in parts(batches):
            ids = encode_batch(batch.column(text_col), path)
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def decode_documents(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Every row with ``decoded``; a column of that name is replaced."""
    kept, path = [F.col(f"`{c}`") for c in rows.columns if c != "decoded"], path or default_model()

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return decode_batch(ids, path)

    return rows.select(*kept, decode(F.col(ids_col)).alias("decoded"))
