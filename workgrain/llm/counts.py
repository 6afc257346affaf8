"""Token totals by source, language and tokenizer version, kept up to date by signed deltas in idempotent batches."""

from __future__ import annotations

import base64
from collections.abc import Mapping
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tokenizer versions and their rank files.
TOKENIZERS = {"byte_bpe_50k@1": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k@1": "byte_bpe_multi_50k.tiktoken"}
KEYS = ("source", "lang", "tokenizer")


@lru_cache(maxsize=8)
def load(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str) -> Column:
    """Tokens of a whole text; a null or empty text has none."""

    @F.arrow_udf("long")
    def count(batch: pa.Array) -> pa.Array:
        encode = load(path).encode_ordinary
        return pa.array([len(encode(t.as_py() or "")) for t in batch], pa.int64())

    return count(text)


class TokenRollup:
    """Three append-only tables below one shared folder, each with a part for every batch.

    ``ledger``: what a batch made of each document it names (its counts, or that it is gone).
    ``deltas``: signed changes of documents and tokens by source, language and tokenizer.
    ``commits``: the numbers of finished batches; written last, and what decides whether a part counts.

    A batch that failed half-way overwrites its own parts when it is sent again; a batch that is committed
    is ignored when it is sent again. So any batch may be repeated any number of times. Batches of one
    rollup are applied one after the other, with rising numbers: a repeated document belongs to its latest batch, and a
    new batch with a number below one that is committed is refused. Ids of any type are compared as text.
    """

    def __init__(self, spark: SparkSession, root: str, tokenizers: Mapping[str, str] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.tokenizers = dict(tokenizers or {k: public_tokenizers.path(f) for k, f in TOKENIZERS.items()})
        spark.createDataFrame([], "batch long").write.mode("ignore").parquet(f"{self.root}/commits/batch_id=-1")

    def committed(self) -> list[int]:
        """Numbers of committed batches: one for each batch, however many documents it held."""
        rows = self.spark.read.schema("batch long, batch_id long").parquet(f"{self.root}/commits")
        return sorted(r[0] for r in rows.select("batch").distinct().collect())

    def _parts(self, table: str, schema: str) -> DataFrame | None:
        done = self.committed()
        if not done:
            return None
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{table}/batch_id={b}" for b in done))

    def ledger(self, touched: DataFrame | None = None) -> DataFrame | None:
        """Latest state of every document in a committed batch: (doc_id, batch, live, source, lang, counts).

        With ``touched`` (doc_id) only of these documents; the others' rows are left out before any are grouped.
        """
        rows = self._parts("ledger", LEDGER)
        if rows is None:
            return None
        if touched is not None:
            rows = rows.join(touched.where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
        latest = rows.groupBy("doc_id").agg(F.max_by(F.struct("batch", "live", "source", "lang", "counts"), "batch").alias("s"))
        return latest.select("doc_id", "s.*")

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply (doc_id, op, seq, text, source, lang) rows; False if the batch was committed before.

        op 'upsert' inserts a document or revises its text, source or language; 'delete' removes it. Of several
        changes of a document in a batch the one with the largest seq counts (null: the smallest; of equal ones a delete
        counts). Deleting an unknown document changes nothing. A null source or language is a group of its own.
        Every upsert without a doc_id is a document that can never be revised; a delete without one and a row
        with another op or none change nothing. Further columns are ignored.
        """
        done = self.committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}: numbers must rise")
        live = F.col("op") == "upsert"
        useful = (F.col("op") == "delete") & F.col("doc_id").isNotNull() | live
        counted = changes.where(useful).select(
            F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("spread"), "op", "seq", "source", "lang", F.xxhash64("text", "source", "lang").alias("same"),
            F.array(*(F.when(live, token_count(F.when(live, F.col("text")), path)) for path in self.tokenizers.values())).alias("counts"))
        order = Window.partitionBy("doc_id", "spread").orderBy(F.desc("seq"), F.when(live, 1).otherwise(0), "same")
        last = counted.withColumn("nth", F.row_number().over(order)).where("nth = 1")
        last.select("doc_id", F.lit(batch).cast("long").alias("batch"), live.alias("live"), "source", "lang", "counts").write.mode(
            "overwrite").parquet(f"{self.root}/ledger/batch_id={batch}")
        new = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/batch_id={batch}").where("live")
        signed = new.select(F.lit(1).alias("sign"), "source", "lang", "counts")
        touched = self.spark.read.schema(LEDGER).parquet(f"{self.root}/ledger/batch_id={batch}").select("doc_id")
        before = self.ledger(touched)
        if before is not None:
            signed = signed.union(before.where("live").select(F.lit(-1).alias("sign"), "source", "lang", "counts"))
        names = F.array(*map(F.lit, self.tokenizers))
        each = signed.select("sign", "source", "lang", F.explode(F.arrays_zip(names.alias("tokenizer"), F.col("counts").alias("n"))).alias("c"))
        each.groupBy("source", "lang", F.col("c.tokenizer").alias("tokenizer")).agg(
            F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("c.n")).alias("n_tokens"),
        ).write.mode("overwrite").parquet(f"{self.root}/deltas/batch_id={batch}")
        self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/commits/batch_id={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens: the sum of all committed deltas; groups without documents are left out."""
        rows = self._parts("deltas", DELTAS)
        if rows is None:
            rows = self.spark.createDataFrame([], DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where(
            "n_docs <> 0 OR n_tokens <> 0")


LEDGER = "doc_id string, batch long, live boolean, source string, lang string, counts array<bigint>"
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
