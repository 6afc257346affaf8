"""Corpus pipeline: language, quality, near copies, packing. Each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workgrain.llm import jaccard, language, packing, quality
from workgrain.llm.shared import id_remainder, stored
from workgrain.plans.registry import query

LEAST_LANGUAGE_SCORE = 0.3
NEAR_COPY = {"words": 5, "num": 80, "den": 100}

#: The stages are compression, regression and packing steps that SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def whole_rows(docs: DataFrame) -> DataFrame:
    """The text beside the whole row, so that no column's name can clash with a stage's own."""
    return docs.select("text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; without letters or with a score below the least they go."""
    model = language.train(docs.where(F.coalesce(id_remainder("doc_id", 4) != 2, F.lit(False))))
    told = language.identify(whole_rows(docs), model)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the cut."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels.where(F.coalesce(id_remainder("doc_id", 5) != 0, F.lit(False))))
    return quality.score(whole_rows(docs), model).where("predicted = 1").select("row.*")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at five words and a similarity of 0.8."""
    return jaccard.one_of_each(docs, **NEAR_COPY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("quality_classifier", good_quality),
    ("ngram_jaccard", no_near_copies),
    ("best_fit_packing", packed),
]


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
