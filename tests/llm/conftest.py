from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the long word list goes on and on without any end " * 20_000


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        (1, "the cat and the dog of the house", "en", "a", 5),
        (1, "the cat and the dog of the house", "en", "a", 5),
        (1, "another text under the same number", "en", None, None),
        (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "de", None, 4), (5, "!!! 123 ???", None, None, 2),
        (6, LONG, "en", "b", len(LONG)), (7, LONG + "tail", "en", "b", None), (None, "a text without number", None, None, None),
        (None, None, None, None, None), (8, "der hund und die katze im haus", "de", "a", 1),
        (9, "released under the MIT License, not the Apache License", "en", "a", 1), (10, "x" * 50_000, "en", "a", 1),
        (11, "🤗 ▁mark <|endoftext|> <s> \x00 é", "fr", "a", 3),
    ]
    names = ("score", "ids", "node", "label", "rule", "lang_pred", "predicted", "n", "k", "decoded", "piece", "batch")
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCUMENTS)
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
