"""License scan by diagonal voting: rolling word n-grams joined to template positions, votes added up by offset."""

from __future__ import annotations

import string
from collections.abc import Mapping
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jaccard import MULTIPLIER, mix

#: Phrases that count wherever their words stand consecutively, with their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit",
}

#: Opening words of common public notices and short license lines, with labels of the method's own.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-notice",
    "released under the mit license": "mit-line",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-notice",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this work is licensed under a creative commons attribution": "cc-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-notice",
    "this source code form is subject to the terms of the mozilla public license": "mpl-notice",
}

GRAM = 2
NEIGHBOUR = 2
COVERED = 0.8
STRETCH = 1.25
ROWS = 1 << 17
SPANS = "array<struct<start: long, words: long, held: long>>"

_WORD = set(range(0x80, 0x100)) | set((string.digits + string.ascii_letters).encode())
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def rolling(words: list[bytes], gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` words, by start."""
    n = len(words) - gram + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    run = h[:n].copy()
    for i in range(1, gram):
        run = run * np.uint64(MULTIPLIER) + h[i : n + i]
    return mix(run).view(np.int64)


def template_table(spark: SparkSession, templates: Mapping[str, tuple[str, bool]], gram: int) -> DataFrame:
    """(hash, template, at): where each n-gram stands in each template."""
    rows = []
    for phrase in templates:
        found = rolling(words_of(phrase), gram)
        if not len(found):
            raise ValueError(f"{phrase!r} has fewer than {gram} words")
        rows += [(int(h), phrase, at) for at, h in enumerate(found)]
    return spark.createDataFrame(rows, "hash long, template string, at long")


def votes(docs: DataFrame, templates: DataFrame, gram: int) -> DataFrame:
    """Diagonals: per text and template the offsets with the template positions that agree there."""

    def roll(batches):
        for batch in batches:
            ids, texts = [], []
            starts, hashes, held = [], [], 0
            for row in range(batch.num_rows):
                h = rolling(words_of(batch.column("text")[row].as_py()), gram)
                for i in range(0, len(h), ROWS):
                    part = h[i : i + ROWS]
                    ids.append(np.full(len(part), row))
                    starts.append(np.arange(i, i + len(part)))
                    hashes.append(part)
                    held += len(part)
                    if held >= ROWS:
                        yield out(batch, ids, starts, hashes)
                        ids, starts, hashes, held = [], [], [], 0
            if held:
                yield out(batch, ids, starts, hashes)

    def out(batch, ids, starts, hashes):
        at = pa.array(np.concatenate(ids))
        return pa.record_batch({
            "doc_id": batch.column("doc_id").take(at), "text_hash": batch.column("text_hash").take(at),
            "start": pa.array(np.concatenate(starts)), "hash": pa.array(np.concatenate(hashes))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    grams = docs.mapInArrow(roll, f"doc_id {kind}, text_hash long, start long, hash long")
    hits = grams.join(F.broadcast(templates), "hash")
    return (
        hits.groupBy("doc_id", "text_hash", "template", (F.col("start") - F.col("at")).alias("diagonal"))
        .agg(F.collect_set("at").alias("agree")))


def spans_of(parts: list[dict], size: int, gram: int) -> list[dict]:
    """Spans of one template, not overlapping in the text, from the diagonals of one stretch of a text.

    Runs of agreeing positions are chained in the order of text and template, each at most ``NEIGHBOUR`` beside
    the one before, whatever stands between them; a word of text or template counts once. Of the chains within
    ``STRETCH`` times the template, those that hold the most words come first, then the shortest.
    """
    runs = []
    for part in parts:
        offset, agree = part["diagonal"], sorted(part["agree"])
        cuts = [0, *(i for i in range(1, len(agree)) if agree[i] > agree[i - 1] + 1), len(agree)]
        runs += [(offset + agree[i], agree[i], agree[j - 1] + gram - agree[i], offset) for i, j in pairwise(cuts)]
    runs.sort()
    most, chains, seen = int(STRETCH * size), [], {}
    for start, at, words, offset in runs:
        held = {start: words}
        for beside in range(offset - NEIGHBOUR, offset + NEIGHBOUR + 1):
            for other, other_at, other_words, other_held in seen.get(beside, ()):
                if other >= start or other_at >= at:
                    continue
                gain = words - max(0, other + other_words - start, other_at + other_words - at)
                if gain > 0:
                    for first, n in other_held.items():
                        if start + words - first <= most:
                            held[first] = max(held.get(first, 0), n + gain)
        best, kept = 0, {}
        for first in sorted(held, reverse=True):  # an earlier start is worth keeping only with more words
            if held[first] > best:
                best = kept[first] = held[first]
        seen.setdefault(offset, []).append((start, at, words, kept))
        chains += [(-n, start + words - first, first) for first, n in kept.items()]
    out, taken = [], set()
    for n, words, first in sorted(chains):
        if taken.isdisjoint(range(first, first + words)):
            taken.update(range(first, first + words))
            out.append({"start": first, "words": words, "held": -n})
    return out


def scan(docs: DataFrame, phrases: Mapping[str, str] = BASE_PHRASES, notices: Mapping[str, str] = NOTICES,
         id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """Verified spans: doc_id, text_hash, template, label, base, start, words, covered.

    A base phrase is a span where every n-gram of the phrase agrees on one diagonal. For a notice, diagonals of
    one text less than ``NEIGHBOUR`` + 1 apart (a word inserted or left out moves the offset by one) are merged
    by ``spans_of`` as long as their spans touch; diagonals of other offsets in between (words that the notice
    repeats) do not part them. The merged span counts if it covers at least ``COVERED`` of the notice's
    words within ``STRETCH`` times its length. Rows below that keep ``label`` null and only their cover. A word
    is covered with its neighbour only: a change next to a notice's outer word leaves that word uncovered too.
    The templates are a parameter and are broadcast: their size does not depend on the documents. A
    repeated row (id and text) has one set of spans.
    """
    spark = docs.sparkSession
    kinds = {p: (label, True) for p, label in phrases.items()} | {p: (label, False) for p, label in notices.items()}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    found = votes(rows, template_table(spark, kinds, gram), gram)
    known = spark.createDataFrame([(p, *k, len(words_of(p))) for p, k in kinds.items()],
                                  "template string, label string, base boolean, size long")
    found = found.join(F.broadcast(known), "template")
    exact = found.where("base AND size(agree) = size - " + str(gram - 1)).select(
        "doc_id", "text_hash", "template", "label", "base", F.col("diagonal").alias("start"),
        F.col("size").alias("words"), F.lit(1.0).alias("covered"))
    first = F.col("diagonal") + F.array_min("agree")
    last = F.col("diagonal") + F.array_max("agree") + (gram - 1)
    loose = found.where("NOT base").select("*", first.alias("first"), last.alias("last"))
    each = Window.partitionBy("doc_id", "text_hash", "template").orderBy("first", "last", "diagonal")
    reach = F.max("last").over(each.rowsBetween(Window.unboundedPreceding, -1))
    new = reach.isNull() | (F.col("first") > reach + NEIGHBOUR + 1)
    stretches = (
        loose.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("stretch", F.sum("new").over(each))
        .groupBy("doc_id", "text_hash", "template", "label", "base", "size", "stretch")
        .agg(F.min("first").alias("start"), (F.max("last") - F.min("first") + 1).alias("words"),
             F.collect_list(F.struct("diagonal", "agree")).alias("parts")))

    @F.arrow_udf(SPANS)
    def chained(parts: pa.Array, sizes: pa.Array) -> pa.Array:
        return pa.array([p and spans_of(p, n, gram) for p, n in zip(parts.to_pylist(), sizes.to_pylist(), strict=True)],
                        pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "words", "held")])))

    agree = F.col("parts")[0]["agree"]
    held = F.size(F.array_distinct(F.flatten(F.transform(agree, lambda a: F.sequence(a, a + (gram - 1)))))).cast("long")
    alone = F.array(F.struct("start", "words", held.alias("held")))
    several = F.when(F.size("parts") > 1, F.col("parts"))
    merged = (
        stretches.withColumn("several", chained(several, F.col("size")))
        .withColumn("span", F.explode(F.coalesce("several", alone)))
        .select("doc_id", "text_hash", "template", "label", "base", "size", "span.*"))
    share = F.col("held") / F.col("size")
    whole = (share >= COVERED) & (F.col("words") <= STRETCH * F.col("size"))
    spans = merged.select("doc_id", "text_hash", "template", F.when(whole, F.col("label")).alias("label"), "base", "start",
                          "words", share.alias("covered"))
    return exact.unionByName(spans)


def label_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are their smallest and largest start, null
    without any. Labels are distinct, sorted and joined by commas, empty without any. score: largest cover of
    any template, 0 without an agreeing n-gram. A null or empty text has 0 words and no spans.
    """

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())

    spans = scan(docs, id_col=id_col, text_col=text_col, **how)
    joined = lambda base: F.concat_ws(",", F.sort_array(F.collect_set(F.when(base, F.col("label")))))
    start = F.when(F.col("base"), F.col("start"))
    by_text = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__text")).agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.lit(True)).alias("labels"), F.max("covered").alias("score"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       count(F.col(text_col)).alias("n_words"))
    same = rows["doc_id"].eqNullSafe(by_text["__id"]) & (rows["text_hash"] == by_text["__text"])
    return rows.join(by_text, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
