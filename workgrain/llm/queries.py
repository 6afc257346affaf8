"""Registered queries of the training-data operators: each applies its operator to the whole table."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..session import scratch_dir
from . import codes, counts, jaccard, language, licenses, main_text, packing, pieces, quality, resampling, topk, urls, vafile
from .shared import id_remainder, may_be_in, sketch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_ngram_jaccard")
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.jaccard_components(docs, words=4, num=85, den=100).drop("text_hash", "representative")


@query("op2_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = quality.train(docs, labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_license_scan")
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.label_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, take down the toxic ones, revise the bad ones, and send the first batch again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").dropDuplicates(["doc_id"])
    rollup = counts.TokenRollup(spark, scratch_dir(spark, "token-rollup"))
    inserts = docs.select("*", F.lit("upsert").alias("op"), F.lit(0).alias("seq"))
    rollup.apply(1, inserts)
    none = F.lit(None).cast("string")
    deletes = labels.where("toxic = 1").select(
        "doc_id", none.alias("text"), none.alias("source"), none.alias("lang"), F.lit("delete").alias("op"), F.lit(1).alias("seq"))
    bad = labels.where("quality = 0 AND toxic = 0").select("doc_id")
    some = docs.where(may_be_in(F.xxhash64("doc_id"), sketch(bad.select(F.xxhash64("doc_id")))))
    cleaned = some.join(bad, "doc_id").withColumn("text", F.regexp_replace("text", r"[|$%&#*!]+", ""))
    rollup.apply(2, deletes)
    rollup.apply(3, cleaned.select(*docs.columns, F.lit("upsert").alias("op"), F.lit(2).alias("seq")))
    rollup.apply(1, inserts)
    return rollup.totals()


@query("op5_sentencepiece")
def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of every document's ids, and whether they give its text again."""
    path = pieces.default_model()

    def digest(batches):
        for batch in pieces.parts(batches):
            texts = batch.column("text")
            ids = pieces.encode_batch(texts, path)
            again = pieces.decode_batch(ids, path)
            crc = [zlib.crc32(i.values.to_numpy().astype("<u4").tobytes()) if i.is_valid else None for i in ids]
            same = [a == b for a, b in zip(texts.to_pylist(), again.to_pylist(), strict=True)]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_ids": pa.array(ids.value_lengths(), pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "round_trip": pa.array(same, pa.bool_())})

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(digest, f"doc_id {kind}, n_ids long, ids_crc32 long, round_trip boolean")


@query("op6_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
    model = language.train(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_exact_top_k", topk.ORACLE)
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64.0)


@query("op9_embedding_near_dedup", codes.ORACLE)
def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


@query("op10_url_filter", urls.oracle())
def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.default_model(spark)).select("page_id", "host", "path", "rule", "verdict")


@query("op11_importance_resampling", resampling.ORACLE)
def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"),
                               longest=1, buckets=10_000, seed=2024, percent=10, least_words=20)


@query("op12_centroid_clustering", vafile.oracle())
def centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, width=64, scale=1024.0, seed=3)


@query("op13_html_extraction", main_text.ORACLE)
def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
