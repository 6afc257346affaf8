"""Language, quality, licenses and pieces: brute force, round trips, held-out accuracy and odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from workgrain.llm import language, licenses, pieces, quality
from workgrain.llm.shared import id_remainder

MEDIUM = "/root/testdata/sf0.01"


def counted(df):
    return sorted((str(r) for r in df.collect()))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language.train(docs.where(id_remainder("doc_id", 4) != 2), per_language=100)
    told = language.identify(docs, model).where(id_remainder("doc_id", 4) == 2)
    right = [r.lang == r.lang_pred for r in told.select("lang", "lang_pred").collect()]
    assert sum(right) / len(right) > 0.97
    assert all(zlib.crc32(str(i).encode()) % 4 == r for i, r in
               [(x.doc_id, x.r) for x in docs.select("doc_id", id_remainder("doc_id", 4).alias("r")).limit(50).collect()])


def test_language_odd_rows(messy, no_documents):
    model = language.train(messy)
    out = language.identify(messy, model)
    assert set(out.columns) == set(messy.columns) and out.count() == messy.count()
    by_id = {r.doc_id: r for r in out.select("doc_id", "lang_pred", "score").where("doc_id IS NOT NULL").collect()}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (2, 3, 4, 5))
    assert by_id[8].lang_pred == "de" and all(0 <= r.score <= 1 for r in by_id.values())
    assert language.identify(no_documents, model).count() == 0
    nobody = language.identify(messy, language.train(no_documents)).select("lang_pred").distinct().collect()
    assert [r[0] for r in nobody] == ["und"]
    alone = language.train(messy.where("lang = 'de'"))
    assert alone.predict("der hund") == ("de", 1.0)


def test_language_grams_do_not_depend_on_slices(monkeypatch):
    text = "abcdefghij klmno" * 20
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "SLICE", 7)
    assert (language.gram_counts(text) == whole).all()
    assert whole.sum() == len(text) + len(text) - 1 + len(text) - 2


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels.where(id_remainder("doc_id", 5) != 0))
    out = quality.score(docs.join(labels.where(id_remainder("doc_id", 5) == 0), "doc_id"), model)
    rows = out.select("quality", "score", "predicted").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    auc = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert auc > 0.98
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.96
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_odd_rows(spark, messy, no_documents):
    labels = spark.createDataFrame([(1, 1), (8, 0), (9, 1), (None, 1), (2, None), (3, 1), (6, 0), (1, 0), (8, 7)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        out = quality.score(messy, quality.train(messy, some))
        assert set(out.columns) == set(messy.columns) and out.count() == messy.count()
        assert all(0 <= r[0] <= 1 for r in out.select("score").collect())
    assert quality.score(no_documents, quality.train(no_documents, labels)).count() == 0


def test_quality_of_repeated_texts(spark):
    assert quality.own_lines([(0, b"a\nb"), (0, b"a\nc"), (1, b"d")]) == {0: [b"b", b"c"], 1: [b"d"]}
    assert quality.own_lines([(0, b"a\nx"), (0, b"a\nx"), (1, b"x\nd")]) == {0: [b"a"], 1: [b"d"]}
    assert quality.own_lines([(0, b"a\nb"), (1, b"a"), (1, b"a")]) == {0: [b"b"], 1: [b"a"]}
    good = "a label that one text makes up is learned from that text, whose lines all its copies share"
    rows = [(i, good, 1) for i in range(40)] + [(i, f"$$ {i * 7919} || {i * 104729} %% buy {i}", 0) for i in range(40, 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.score(docs, quality.train(docs, docs.select("doc_id", "quality"))).collect()
    assert min(r.score for r in out if r.quality == 1) > max(r.score for r in out if r.quality == 0)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_by_hand(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        own = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(own)] == own]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_licenses_by_hand(spark, messy, no_documents):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").union(messy.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame([
        (-1, "MIT license mit LICENSE; mit license"), (-2, "gnu general public, license gnu general public"),
        (-3, "cc by cc by cc"), (-4, "émit license mit license"),
        (-5, "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and "
             "associated documentation files"),
        (-6, "permission is hereby granted"),
    ], "doc_id long, text string"))
    out = licenses.label_documents(docs)
    want = sorted((r.doc_id is None, r.doc_id or 0, *map(str, base_by_hand(r.text))) for r in docs.collect())
    rows = out.collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, *map(str, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels))) for r in rows)
    assert got == want
    by_id = {r.doc_id: r for r in rows}
    assert by_id[-1].n_base == 3 and by_id[-5].labels == "mit-notice" and by_id[-6].labels == "" and 0 < by_id[-6].score < 0.8
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)
    assert licenses.label_documents(no_documents).count() == 0
    with pytest.raises(ValueError):
        licenses.label_documents(no_documents, phrases={"mit": "mit"})


def edited_notices():
    """(notice, edited words, words still covered): every insertion and every deletion of one word."""
    for notice, label in licenses.NOTICES.items():
        own = notice.split()
        for at in range(len(own) + 1):
            yield label, own[:at] + ["zzz"] + own[at:], len(own) - (at in (1, len(own) - 1))
        for at in range(len(own)):
            outer = at in (1, len(own) - 2)  # the word outside it has no neighbour left
            yield label, own[:at] + own[at + 1 :], len(own) - 1 - outer


def test_licenses_with_one_word_changed(spark):
    size = {label: len(notice.split()) for notice, label in licenses.NOTICES.items()}
    cases = [(i, *case) for i, case in enumerate(edited_notices())]
    docs = spark.createDataFrame([(i, "xx yy " + " ".join(words) + " ww") for i, _, words, _ in cases], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.label_documents(docs).collect()}
    lost = [(label, " ".join(words)) for i, label, words, held in cases
            if held / size[label] >= licenses.COVERED and label not in got[i]]
    assert not lost
    assert sum(held / size[label] < licenses.COVERED for _, label, _, held in cases) < 20


def test_license_spans(spark):
    apache, mit = list(licenses.NOTICES)[1], "released under the mit license"
    own = apache.split()
    docs = spark.createDataFrame([
        (1, apache + " " + apache), (2, mit + " mit license"), (3, " ".join(own[:9] + ["zzz"] + own[9:])),
        (4, "the license " * 2000), (5, " ".join(w + " zzz" for w in own)),
    ], "doc_id long, text string")
    spans = licenses.scan(docs, phrases={}).where("label IS NOT NULL").collect()
    got = sorted((r.doc_id, r.label, r.start, r.words, r.covered) for r in spans)
    n = len(own)
    assert got == [(1, "apache-notice", 0, n, 1.0), (1, "apache-notice", n, n, 1.0), (2, "mit-line", 0, 5, 1.0),
                   (3, "apache-notice", 0, n + 1, 1.0)]


ODD = ["", " ", "   ", "\n", "\n\n a", "a  b   c\n\td", "  lead", "é ﬁ é 🤗  z", "<s> <0x0A> </s>", "a" * 3000, "=====----- ++",
       "\x00​　x", "日本語テキスト 東京", "don't 12345678 3.14", "▁x▁▁y"]


def test_pieces_are_the_models_own(spark):
    path = pieces.default_model()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text").collect()] + ODD
    own = pieces.Pieces(path)
    got = own.encode_texts(texts)
    assert [g.tolist() for g in got] == model.encode(texts)
    assert [own.decode(g) for g in got] == [t.replace("▁", " ") for t in texts]


def test_pieces_forget_words_and_stay_right(monkeypatch):
    monkeypatch.setattr(pieces, "WORDS_KEPT", 3)
    own = pieces.Pieces(pieces.default_model())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for text in ("one two three four", "two three five six seven", "one six " + "y" * 80, "four"):
        assert own.encode_texts([text])[0].tolist() == model.encode(text)


def test_pieces_odd_rows(messy, no_documents):
    both = pieces.decode_documents(pieces.encode_documents(messy))
    rows = both.select("text", "ids", "decoded").collect()
    assert len(rows) == messy.count()
    assert all((r.ids is None) == (r.text is None) and r.decoded == (r.text and r.text.replace("▁", " ")) or r.text == "" == r.decoded for r in rows)
    assert pieces.encode_documents(no_documents).count() == 0


def test_quality_equals_a_slow_version(spark):
    """Sizes by zstandard with the trained dictionaries in one-shot calls, then the logistic formula, row by row."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    model = quality.train(docs, labels.where(id_remainder("doc_id", 5) != 0))
    assert model.good and model.bad and any(model.weights)
    trained = [zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO) for d in (model.good, model.bad)]
    slim = zstandard.ZstdCompressionParameters.from_level(
        3, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)

    def slow(text):
        data, sizes = (text or "").encode(), []
        for d in trained:
            tool = zstandard.ZstdCompressor(compression_params=slim, dict_data=d)
            pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)]
            for p in pieces:
                back = zstandard.ZstdDecompressor(dict_data=d, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
                assert back.decompress(tool.compress(p), max_output_size=4096) == p
            sizes.append(sum(len(tool.compress(p)) for p in pieces))
        good, bad = sizes
        both = good + bad + 64
        x = [(bad - good) / both, min(0.0, math.log(both / (2 * len(data) * 0.25)))] if data else [0.0, 0.0]
        odds = sum(w * v for w, v in zip(model.weights, x, strict=True)) + model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))

    rows = quality.score(docs, model).select("text", "score", "predicted").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = slow(r.text)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.3)


def test_language_equals_a_slow_version(spark):
    """Margins by a sum over explicit grams, one at a time, and the votes of the duels counted by hand."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").where("length(text) < 1500")
    model = language.train(docs.where(id_remainder("doc_id", 4) != 2), per_language=60)
    full = 0xFFFFFFFF

    def place(code):
        return ((code ^ (code >> 15)) * 0x2C1B3C6D & full) >> (32 - language.BITS)

    def duel(names, margin):
        wins = {n: [0, 0.0, 1.0] for n in names}
        for a, b in margin:
            if a in names and b in names:
                for n, m in ((a, margin[a, b]), (b, -margin[a, b])):
                    wins[n][0] += m > 0
                    wins[n][1] += m
                    wins[n][2] = min(wins[n][2], 1 / (1 + math.exp(-model.slope * m)))
        best = sorted(names, key=lambda n: (-wins[n][0], -wins[n][1], n))[0]
        return best, wins[best][2]

    def slow(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        c, grams = [ord(x) for x in text.lower()], Counter()
        for i, x in enumerate(c):
            grams[place(x * 0x165667B1 & full)] += 1
            if i:
                pair = (c[i - 1] * 0x9E3779B1 + x * 0x85EBCA6B) & full
                grams[place(pair)] += 1
            if i > 1:
                before = (c[i - 2] * 0x9E3779B1 + c[i - 1] * 0x85EBCA6B) & full
                grams[place((before * 0xC2B2AE35 + x * 0x27D4EB2F) & full)] += 1
        length = math.sqrt(sum(grams.values()))
        margin = {
            pair: sum(math.sqrt(n) / length * model.weights[g, j] for g, n in grams.items()) + model.weights[-1, j]
            for j, pair in enumerate(model.pairs)}
        family, sure = duel(sorted(set(model.families.values())), margin)
        told, own = duel([n for n in model.languages if model.families[n] == family], margin)
        return told, sure * own

    rows = language.identify(docs, model).select("text", "lang_pred", "score").limit(400).collect()
    assert len(rows) > 100
    for r in rows:
        told, sure = slow(r.text)
        assert r.lang_pred == told and r.score == pytest.approx(sure, abs=1e-4)
