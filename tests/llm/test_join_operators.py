"""Jaccard join, vector search and vector near-dedup against brute force, with odd rows."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from workgrain.llm import codes, jaccard, topk
from workgrain.llm.shared import components

VECTORS = "vec_id long, embedding array<float>, label int"


def smallest_reachable(nodes, links):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def shingles(text, words):
    found = (text or "").encode().lower().split()
    return frozenset(tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))) if found else frozenset()


def brute(rows, words, num, den):
    sets = {i: shingles(t, words) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    top = smallest_reachable(sets, links)
    return {i: (len(s), top[i]) for i, s in sets.items()}


def edited(seed):
    """Families of texts with words changed, dropped, doubled or added, around the threshold."""
    r, out = random.Random(seed), []
    for family in range(12):
        base = [f"w{r.randrange(500)}" for _ in range(r.choice((3, 4, 5, 9, 14, 30, 80, 200)))]
        for _ in range(9):
            text = list(base)
            for _ in range(r.choice((0, 0, 1, 1, 2, 3))):
                at = r.randrange(len(text) + 1)
                text[at : at + r.randrange(2)] = [f"w{r.randrange(500)}"] * r.randrange(2)
            out.append((len(out), " ".join(text)))
    return out + [(len(out), ""), (len(out) + 1, None), (len(out) + 2, "A b C"), (len(out) + 3, "a B\tc"), (len(out) + 4, "a b")]


@pytest.mark.parametrize("words,num", [(4, 85), (5, 80), (2, 60)])
def test_jaccard_equals_brute_force(spark, words, num):
    rows = edited(words)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=words, num=num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, num, 100)


@pytest.mark.parametrize("words,num,block", [(4, 85, 2048), (2, 60, 3)])
def test_jaccard_link_counts(spark, monkeypatch, words, num, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = edited(words)
    rows += [rows[0], rows[20], (None, rows[0][1]), (None, None), (5000, rows[0][1])]
    sets = [shingles(t, words) for _, t in rows]
    want = [sum(i != j and bool(a) and 100 * len(a & b) >= num * len(a | b) for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard.link_counts(spark.createDataFrame(rows, "doc_id long, text string"), words=words, num=num).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted((str(i), n) for (i, _), n in zip(rows, want))
    assert max(want) > 3


def test_jaccard_tables(spark, small):
    rows = [tuple(r) for r in small.select("doc_id", "text").collect()]
    got = jaccard.jaccard_components(small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85, 100)


def test_jaccard_blocks_and_seeds(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = edited(77)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), words=2, num=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 2, 85, 100)


def test_similar_sets_share_a_key():
    r = random.Random(5)
    for num in (85, 80):
        bands = jaccard.Bands(num, 100)
        for _ in range(1500):
            n = r.choice((1, 2, 5, 7, 8, 11, 12, 13, 17, 25, 60, 150))
            a = {r.getrandbits(64) for _ in range(n)}
            b = set(a)
            for _ in range(r.randrange(0, n * (100 - num) // num + 2)):
                b.discard(r.choice(sorted(b))) if b and r.random() < 0.5 else b.add(r.getrandbits(64))
            if b and 100 * len(a & b) >= num * len(a | b):
                x, y = (np.sort(np.array(list(s), dtype=np.uint64)) for s in (a, b))
                assert len(a ^ b) == 0 or set(bands.keys(x).tolist()) & set(bands.keys(y).tolist())


def test_bitmaps_never_rule_out_a_link():
    r = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, r.integers(5, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.95], r.integers(0, 2**63, r.integers(0, 20)).astype(np.uint64)]))
        shared, all_ = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        assert jaccard.linked(a, b, 85, 100) == (100 * shared >= 85 * all_)


def test_jaccard_odd_rows(messy, no_documents):
    out = jaccard.jaccard_components(messy)
    rows = out.collect()
    assert len(rows) == messy.count()
    assert {r.n_shingles for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert all(r.component_id == r.doc_id for r in rows if r.n_shingles == 0)
    kept = jaccard.one_of_each(messy, words=4, num=85)
    assert kept.columns == messy.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    assert jaccard.jaccard_components(no_documents).count() == 0
    with pytest.raises(ValueError):
        jaccard.jaccard_components(messy, num=40)


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain.union(spark.createDataFrame([(100, 99), (99, 100), (98, 99)], "a long, b long"))).collect()
    assert {r.node: r.component for r in got} == {n: 0 for n in range(61)} | {98: 98, 99: 98, 100: 98}


ODD_VECTORS = [
    (None, [1.0, 0.5], 1), (40, None, 1), (60, [], 1), (80, [1.0, None], 1), (100, [float("nan"), 1.0], 1), (120, [float("inf"), 1.0], 1),
    (140, [0.0, 0.0], 1), (160, [1.0, 0.5], 1), (161, [1.0, 0.5], 1), (161, [1.0, 0.5], 1), (162, [2.0, 1.0], 1), (163, [1.0, 0.5], None),
    (164, [1.0, 0.5], 2), (180, [1.0, 0.5, 0.0], 1), (181, [-1.0, -0.5], 1),
]


def by_hand_top(rows, k):
    ok = [(i, [int(np.floor(64.0 * np.float64(np.float32(x)))) for x in v]) for i, v, _ in rows
          if v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i is not None and i % 20 == 0}:
        near = [(-sum(x * y for x, y in zip(a, b)), float("inf") if c is None else c) for c, b in ok if c != q and len(b) == len(a)]
        out += [(q, n + 1, None if c == float("inf") else c, -s) for n, (s, c) in enumerate(sorted(near)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [4, 8192])
def test_top_k_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    got = topk.top_k(spark.createDataFrame(ODD_VECTORS, VECTORS), k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == by_hand_top(ODD_VECTORS, 4)
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0


def test_branch_and_bound_is_exact():
    r = np.random.default_rng(1)
    for spread in (0.0, 2.0):
        c = np.floor(r.standard_normal((700, 70)) * np.exp(-spread * np.arange(70) / 10) * 64)
        q, ids = c[::50], r.permutation(700)
        row, at, score = topk.best_of_block(q, c, ids, ids[::50], 20)
        full = q @ c.T
        for i in range(len(q)):
            want = [x for x in np.lexsort((ids, -full[i])) if ids[x] != ids[i * 50]][:20]
            assert at[row == i].tolist() == want and (score[row == i] == full[i][want]).all()


@pytest.mark.parametrize("block", [3, 2048])
def test_near_vectors_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(codes, "BLOCK", block)
    r = np.random.default_rng(9)
    rows = [(1000 + i, (v + 0.06 * r.standard_normal(24)).tolist(), i % 2) for i, v in
            enumerate(np.repeat(r.standard_normal((8, 24)), 6, axis=0))]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows + ODD_VECTORS]
    ok = [label is not None and bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    links = [(a, b) for a, b in combinations(range(len(rows)), 2) if ok[a] and ok[b] and rows[a][2] == rows[b][2]
             and len(rows[a][1]) == len(rows[b][1])
             and np.dot(rows[a][1], rows[b][1]) / np.linalg.norm(rows[a][1]) / np.linalg.norm(rows[b][1]) >= 0.98]
    top = smallest_reachable(range(len(rows)), links)
    ids = {t: min((rows[n][0] for n in top if top[n] == t and rows[n][0] is not None), default=None) for t in set(top.values())}
    want = sorted(str((rows[n][0], sum(n in p for p in links), ids[top[n]], rows[n][0] is not None and rows[n][0] == ids[top[n]])) for n in top)
    got = codes.near_vectors(spark.createDataFrame(rows, VECTORS))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == want and len(links) > 20
    assert codes.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def near_families():
    r = np.random.default_rng(2)
    v = r.standard_normal((400, 32))
    v[200:] = v[:200] + 0.3 * r.standard_normal((200, 32))
    return v


def test_codes_bound_and_estimate():
    v = near_families()
    made, factor = codes.encode(v)
    u = codes.unit(v)
    turned, true, other = u @ codes.rotation(32).T, u @ u.T, ~np.eye(400, dtype=bool)
    estimate, confidence, most = codes.estimates(made, factor, turned)
    assert (true <= most + 1e-4).all()
    assert abs((estimate - true)[other].mean()) < 0.01
    assert (np.abs(estimate - true) <= confidence)[other].mean() > 0.999
    near = other & (true > 0.8)  # without the stored factor the estimate falls short
    assert abs((estimate - true)[near].mean()) < 0.02 < 0.1 < abs((codes.estimates(made, np.ones(400), turned)[0] - true)[near].mean())


def test_the_estimate_settles_what_is_computed():
    """Few pairs are computed, nearly all links are among those that the estimate picks, and the bound adds the rest."""
    v = near_families()
    made, factor = codes.encode(v)
    rows, told, blunt = np.arange(400), {}, {}
    links = codes.links_of_block(v, made, factor, rows, rows, 0.93, told)
    u = codes.unit(v)
    want = {(a, b) for a, b in combinations(range(400), 2) if float(np.einsum("i,i", u[a], u[b])) >= 0.93}
    assert {tuple(sorted(p)) for p in links.tolist()} == want and len(want) > 50
    assert told["pairs"] == 400 * 399 // 2 and told["picked"] + told["added"] < told["pairs"] / 5
    assert told["links_picked"] >= 0.99 * len(want) and told["links_picked"] + told["links_added"] == len(want)
    codes.links_of_block(v, made, np.ones(400), rows, rows, 0.93, blunt)
    assert blunt["links_picked"] < 0.5 * len(want)


def test_a_pair_is_decided_alike_whatever_its_block():
    """Whole blocks and single pairs decide by one inner product: a threshold that is some pair's own cosine."""
    v = near_families()
    u = codes.unit(v)
    for a, b in ((0, 200), (5, 205), (7, 207)):
        least = float(np.einsum("ij,ij->i", u[[a]], u[[b]])[0])
        dense = np.ones((400, 400), dtype=bool)
        sparse = np.zeros((400, 400), dtype=bool)
        sparse[a, b] = True
        assert [a, b] in codes.linking(u, np.arange(400), np.arange(400), dense, least).tolist()
        assert codes.linking(u, np.arange(400), np.arange(400), sparse, least).tolist() == [[a, b]]


def test_sets_that_cannot_link_make_no_tile(spark):
    """One-shingle sets link with equal ones only, so a table of short texts has no tile, and takes no longer than others."""
    short = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.lit("b"), F.lit("c"), "id").alias("text"))
    docs = short.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    features, nodes, seed = jaccard._named(docs, 4)
    assert nodes.count() == 3000 and seed == 0
    assert jaccard._tiles(jaccard._keys(docs, nodes, 4, 85, 100, seed)).count() == 0
    bands = jaccard.Bands(85, 100)
    sizes = [len(bands.keys(np.arange(n, dtype=np.uint64))) for n in range(1, 9)]
    assert sizes[:5] == [0] * 5 and sizes[5] == 1 and sizes[6] == 8
    linked = short.union(short.where("doc_id < 5").select(F.col("doc_id") + 9000, F.upper("text")))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(linked).collect()}
    assert all(got[9000 + i] == i for i in range(5)) and len(set(got.values())) == 3000


def test_two_sets_of_one_name_are_named_anew(spark, monkeypatch):
    rows = [(1, "one two three four five"), (2, "six seven eight nine ten"), (3, "one two three four five")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs = df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seeds = []
    real = jaccard._features

    def features(d, words, seed):
        seeds.append(seed)
        out = real(d, words, seed)
        return out.withColumn("node", F.lit(7).cast("long")) if seed == 0 else out

    monkeypatch.setattr(jaccard, "_features", features)
    _, nodes, seed = jaccard._named(docs, 4)
    assert seeds == [0, 1] and seed == 1 and nodes.count() == 2


def test_rows_kept_whatever_their_columns_are_called(spark):
    names = ("mark", "row", "maybe", "known_id", "nth", "__hash", "__id", "text_hash", "node")
    df = spark.createDataFrame([(i % 7, f"some words that make a text of their own {i % 5}") for i in range(40)], "doc_id long, text string")
    df = df.select("*", *(F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names))
    kept = jaccard.one_of_each(df, words=2, num=99, den=100)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert len({r["text"] for r in rows}) == len(rows) == 5
    assert all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)
