"""Resampling, clustering and main text against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from workgrain.llm import main_text, markup, resampling, vafile

PAGES = "page_id long, url string, html string"


# Resampling


def test_crc_of_spans_equals_zlib():
    r = random.Random(4)
    data = r.randbytes(9000)
    spans = [(s := r.randrange(7000), s + r.choice((0, 1, 2, 3, 8, 63, 64, 65, 127, 128, 129, 640, 1999))) for _ in range(4000)]
    start, end = (np.array(x) for x in zip(*spans, strict=True))
    got = resampling.crc32_of_spans(np.frombuffer(data, np.uint8), start, end)
    assert got.tolist() == [zlib.crc32(data[a:b]) for a, b in spans]
    none = np.zeros(0, dtype=np.int64)
    assert len(resampling.crc32_of_spans(np.zeros(0, np.uint8), none, none)) == 0


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_resample(docs, target, longest, buckets, seed, percent, least):
    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = (Counter(bucket(f) for x in side for f in features(x, longest)) for side in ([x for _, x in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        found = [bucket(f) for f in features(text, longest)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in found)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(found), weight, score, len(words(text))))
    able = sorted((-x[3], x[0]) for x in out if x[0] is not None and x[4] >= least)
    drawn = able[: percent * len(able) // 100]
    ranks = defaultdict(list)
    for n, (_, i) in enumerate(drawn, 1):
        ranks[i].append(n)
    return out, ranks


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 97), (3, 1)])
def test_resampling_equals_brute_force(spark, small, longest, buckets):
    docs = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    docs += [(9001, None), (9002, ""), (9003, " \n ,.;"), (None, "no id " * 30), (9004, "É" * 300 + " É2é " * 40), (9005, "w" * 5000), (9006, "A b " * 9000)]
    target = ["Benchmark text of some WORDS, é2é " * 5, None, ""] + [t for _, t in docs[:9]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("weight", "score", "rank", "bucket", "n")})
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(df, bench, longest, buckets, seed=7, percent=30, least_words=20).collect()
    rows, ranks = brute_resample(docs, target, longest, buckets, 7, 30, 20)
    assert sorted(map(repr, ((g["doc_id"], g["n_features"], g["weight"], g["score"], g["n_words"]) for g in got))) == sorted(map(repr, rows))
    assert {g["doc_id"]: [g["rank"]] for g in got if g["rank"] is not None} == dict(ranks)


def test_resampling_of_odd_tables(spark, messy, no_documents):
    bench = spark.createDataFrame([("the cat",)], "text string")
    out = resampling.resample(messy, bench, percent=100, least_words=0).collect()
    assert len(out) == messy.count()
    assert sorted(r["rank"] for r in out if r["rank"] is not None) == list(range(1, sum(r["doc_id"] is not None for r in out) + 1))
    assert all(r["score"] is None and r["rank"] is None for r in out if r["doc_id"] is None)
    assert resampling.resample(no_documents, bench).count() == 0
    assert resampling.resample(messy, bench.limit(0)).count() == messy.count()


# Clustering


def brute_cluster(rows, k, rounds, width, scale, seed):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [list(v) for _, v in first]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        told = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, told, strict=True) if c == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    told = assign()
    per = Counter()
    for d, c in told:
        per[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, per[c], sum(per.values()), names[c]) for (i, _), (d, c) in zip(kept, told, strict=True)]


VECTORS = "vec_id long, embedding array<double>, cluster string, v string, row string"


def points(n, width, seed, groups=5):
    r = random.Random(seed)
    middle = [[r.uniform(-2, 2) for _ in range(width)] for _ in range(groups)]
    return [(i, [c + r.gauss(0, 0.2) for c in r.choice(middle)]) for i in range(n)]


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_clusters_equal_brute_force(spark, bits):
    rows = points(300, 8, bits)
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (900, None), (901, [1.0] * 7), (902, [None] + [0.5] * 7),
             (903, [float("nan")] * 8), (904, [float("inf")] * 8), (905, []), (906, [0.0] * 8), (907, [-900.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], VECTORS)
    told = []
    got = vafile.cluster(df, k=5, rounds=4, width=8, scale=64.0, seed=3, bits=bits, told=told)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute_cluster(rows, 5, 4, 8, 64.0, 3)))
    assert len(told) == 5 and all(sure >= 0 for sure, _ in told)
    if bits == 6:  # well separated groups: the cells alone decide most, and only the rest is fetched again
        assert told[-1][0] > 250 and told[-1][1] < 60


def test_ties_and_few_vectors(spark):
    same = [(i, [1.0, 2.0]) for i in range(6)]
    df = spark.createDataFrame([(i, v, "", "", "") for i, v in same], VECTORS)
    got = vafile.cluster(df, k=4, rounds=3, width=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute_cluster(same, 4, 3, 2, 1024.0, 3))
    two = vafile.cluster(df.limit(2), k=4, rounds=2, width=2).collect()
    assert len(two) == 2 and {r["distance"] for r in two} == {0}
    assert vafile.cluster(df.limit(0), width=2).collect() == []
    assert vafile.cluster(df.withColumn("vec_id", F.lit(None).cast("long")), width=2).collect() == []


def test_intervals_hold_every_distance():
    r = np.random.default_rng(5)
    v = r.integers(-900, 900, (400, 6))
    v[:40] = r.integers(-90_000, 90_000, (40, 6))
    centroids = r.integers(-500, 500, (7, 6))
    edges = np.sort(np.concatenate([np.tile(v.min(axis=0), (1, 1)), r.integers(-900, 900, (7, 6)), v.max(axis=0)[None] + 1]), axis=0).T
    cells = vafile.cells_of(v, edges)
    assert (np.take_along_axis(edges, cells.T, 1).T <= v).all()
    assert (vafile.unpacked(__import__("pyarrow").array(vafile.packed(cells, 3)), 6, 3) == cells).all()
    for r in range(7):
        least, most = vafile.intervals(cells, vafile.lookup(centroids, edges, r))
        exact = ((v[:, None] - centroids[None]) ** 2).sum(axis=2)
        exact = exact - exact[:, r : r + 1]
        assert (least <= exact).all() and (exact <= most).all() and not least[:, r].any()


# Main text


def page(body, head="<title>A title</title><style>p{margin:0}</style><script>var t='</p><article>x</article>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body class='has-sidebar menu'>{body}</body></html>"


def texts_of(spark, rows, **how):
    got = main_text.main_text(spark.createDataFrame(rows, PAGES), **how).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return {r["page_id"]: r for r in got}


def test_named_articles(spark):
    full = page(
        "<header><h2>Site</h2><p>claim</p></header><nav><a href='/'>Home</a></nav><div id='cookie-notice'>We use cookies</div>"
        "<div class=main_column><article class='post'><header><h1>The  Head &amp;\n line</h1><p>by someone</p></header>"
        "<!-- <p>not this</p> --><p>One<br>two <b>bold</b>er &#8364;&nbsp;5 &lt;tag&gt;.<p>Second <a href='x'>link</a>: a < b"
        "<div class='ad-box'>Buy</div><aside>Side</aside><form>Mail <input></form><ul><li>item one<li>item two</ul>"
        "<table><tr><td>r1</td><td>c2</td></tr><tr><td>r2</td></tr></table><div hidden>no</div><div style='display: none'>no</div>"
        "<section class='comments'><article>First!</article></section><footer>foot</footer></article></div>"
        "<aside><article>Teaser</article></aside><footer>&copy; us</footer>")
    got = texts_of(spark, [
        (1, "http://a.b/x", full), (2, None, None), (3, "no host", ""), (4, "http://a.b/y", "plain words only"),
        (5, "http://a.b/z", "<main><p>only</p><nav>menu</nav><p>main</p></main><p>outside</p>"),
        (6, "http://A.b?q", "<div class='page'><form id=f><article>in a form</article></form></div>"),
        (7, "http://a.b#f", "<p>cut <b>off &amp"), (8, "x", "<p>never ends <a href='"), (9, "x", "<p>a<!-- open"), (10, "x", "< 5 <5 <>"),
        (None, "x", "<script>never closed <p>gone"), (11, "x", "<div>" * 3000 + "deep" + "</p></div>" * 3000),
        (12, "x", "<article>" + "word " * 60_000 + "</article>")])
    assert got[1]["text"] == "\n\n".join([
        "The Head & line", "One two bolder € 5 <tag>.", "Second link: a < b", "item one", "item two", "r1 c2", "r2"])
    assert got[1]["basis"] == "article"
    assert (got[2]["text"], got[2]["basis"], got[3]["text"], got[None]["text"]) == ("", None, "", "")
    assert (got[4]["text"], got[5]["text"], got[6]["text"]) == ("plain words only", "only\n\nmain", "in a form")
    assert (got[7]["text"], got[8]["text"], got[9]["text"], got[10]["text"]) == ("cut off &", "never ends", "a", "< 5 <5 <>")
    assert got[11]["text"] == "deep" and got[12]["n_chars"] == 60_000 * 5 - 1


def unnamed(number, rng, host="h.example"):
    menu = "<div><ul>" + "".join(f"<li><a href=/{i}>Entry number {i}</a></li>" for i in range(8)) + "</ul></div>"
    own = "".join(f"<p>{' '.join(f'w{rng.randrange(10**6)}' for _ in range(30))}</p>" for _ in range(3))
    foot = "<div>All rights are with the owners of this site, write to them before any use of it</div>"
    return number, f"https://{host}/{number}", page(f"{menu}<div>{own}</div>{foot}"), re.findall(r"<p>(.*?)</p>", own)


def test_runs_of_a_host_are_boilerplate(spark):
    rng = random.Random(2)
    made = [unnamed(i, rng) for i in range(40)] + [unnamed(100, rng, "alone.example")]
    got = texts_of(spark, [m[:3] for m in made])
    for number, _, _, own in made[:40]:
        assert got[number]["text"] == "\n\n".join(own)
        assert got[number]["basis"] == "runs" and got[number]["n_repeated"] == 24 + 17
    assert got[100]["text"].count("\n\n") == 8 + 3 and got[100]["n_repeated"] == 0  # nothing to compare with
    copies = texts_of(spark, [m[:3] for m in made[:1]] * 3 + [(7, "https://h.example/7", page("<p>something else entirely here</p>"))])
    assert copies[0]["n_repeated"] == 0 and copies[0]["text"].count("\n\n") == 8 + 3  # equal pages are one page


def test_a_page_made_of_repeats_only_keeps_them(spark):
    text = "<p>" + " ".join(f"word{i}" for i in range(40)) + "</p>"
    got = texts_of(spark, [(1, "http://h/1", page(text, "<title>1</title>")), (2, "http://h/2", page(text, "<title>2</title>"))])
    assert {r["basis"] for r in got.values()} == {"copy"} and got[1]["text"].endswith("word39")


def paragraphs(rng, n, words=30):
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]


def article(texts):
    return "<article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"


def test_runs_tell_a_pages_own_article_from_cards(spark):
    rng = random.Random(5)
    pool = [paragraphs(rng, 1, 12) for _ in range(6)]
    made, own = [], {}
    for i in range(40):
        own[i] = paragraphs(rng, 3)
        others = "".join(article(c) for c in rng.sample(pool, 3))
        made.append((i, f"https://h.example/{i}", page(article(own[i]) + others if i else others + article(own[i]), "")))
    got = texts_of(spark, made)
    assert {n: r["text"] for n, r in got.items()} == {n: "\n\n".join(t) for n, t in own.items()}
    assert {(r["basis"], r["n_repeated"]) for r in got.values()} == {("article", 3 * 12)}
    with duckdb.connect() as db:  # the twin takes the first article
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?, ?)", made[1:])
        assert sorted(db.execute(main_text.ORACLE).fetchall()) == [(n, r["url"], r["text"], r["n_chars"]) for n, r in sorted(got.items()) if n]


def test_articles_that_repeat_stay_without_a_longer_own_one(spark):
    rng = random.Random(6)
    passage, copied, posts = paragraphs(rng, 1)[0], paragraphs(rng, 4), [paragraphs(rng, 1) for _ in range(6)]
    bodies = [[[passage, *paragraphs(rng, 2)]] for _ in range(10)]  # the only article keeps what all pages have
    bodies += [[copied, paragraphs(rng, 1, 10)] for _ in range(2)]  # a copied article beside a short one
    bodies += [posts, posts[:2] + posts[4:] + [paragraphs(rng, 1)]]  # lists of posts
    got = texts_of(spark, [(i, "http://h/", page("".join(map(article, b)))) for i, b in enumerate(bodies)])
    assert [got[i]["text"] for i in range(len(bodies))] == ["\n\n".join(t for a in b for t in a) for b in bodies]
    assert [got[i]["n_repeated"] for i in range(14)] == [0] * 10 + [120] * 2 + [120] * 2


def test_articles_do_not_make_other_pages_text_repeated(spark):
    rng = random.Random(7)
    post = paragraphs(rng, 2)
    rows = [(1, "http://h/1", page(article(post) + article(paragraphs(rng, 1)))), (2, "http://h/2", page(article(post) + article(paragraphs(rng, 1)))),
            (3, "http://h/3", page("".join(f"<p>{t}</p>" for t in [*post, *paragraphs(rng, 1)])))]
    got = texts_of(spark, rows)
    assert got[3]["basis"] == "runs" and got[3]["n_repeated"] == 0 and got[3]["text"].startswith("\n\n".join(post))


def brute_runs(streams, run, share):
    """Hashes of the runs on enough distinct pages of a host."""
    out = set()
    for host, pages in streams.items():
        seen = defaultdict(set)
        for number, tokens in pages.items():
            for h in main_text.run_hashes(tokens, run).tolist():
                seen[h].add(number)
        least = max(2, math.ceil(len(pages) * share))
        out |= {(host, h) for h, p in seen.items() if h and len(p) >= least}
    return out


@pytest.mark.parametrize("part_tokens", [1 << 20, 3000, 400])
def test_runs_equal_brute_force_however_many_parts(spark, part_tokens):
    rng = random.Random(part_tokens)
    made = [unnamed(i, rng, f"h{i % 3 if i % 2 else 0}.example")[:3] for i in range(70)] + [(1, None, None), (2, "", "<p>x")]
    rows = spark.createDataFrame(made, PAGES).withColumn("host", main_text.host_of("url"))
    got = {(r[0], r[1] % (1 << 64)) for r in main_text.repeated_runs(main_text.page_streams(rows), 8, 0.05, part_tokens).collect()}
    streams, names = defaultdict(dict), main_text.Names()
    for _, url, html in made:
        host = re.match(r"(?:.*?://([^/?#]*))?", url or "").group(1) or ""
        if html:
            streams[host][html] = main_text.stream(markup.blocks(html), names)[0]
    assert got == brute_runs(streams, 8, 0.05)


def test_runs_equal_brute_force_in_fewer_parts_than_pages_needed(spark):
    test_runs_equal_brute_force_however_many_parts(spark, 5000)


def test_a_hot_host_and_clashing_columns(spark, monkeypatch):
    rng = random.Random(9)
    made = [unnamed(i, rng)[:3] for i in range(60)]
    df = spark.createDataFrame(made, PAGES).withColumns({c: F.lit("x") for c in ("host", "kind", "salt", "text", "run_hash", "tokens")})
    assert {r["basis"] for r in main_text.main_text(df).collect()} == {"runs"}
    monkeypatch.setattr(main_text, "HOT_SIZE", 20_000)
    assert main_text.main_text(df).where("basis = 'runs'").count() == 60
    assert main_text.main_text(df.limit(0)).count() == 0


def test_streams_hold_all_words_of_a_page():
    html = page("<nav><p>menu one</p></nav><article><header>by one two</header><h1>A head</h1><p>own text of it</p></article><footer>foot here</footer>")
    found, names = markup.blocks(html), main_text.Names()
    tokens, at = main_text.stream(found, names)
    assert [e - s for s, e in at] == [len(b.text.split()) for b in found] and (tokens != 0).all()
    inside = [b.said in (markup.ARTICLE, markup.HEADER) for b in found]
    assert sum(inside) == 3 and all(tokens[s:e].tolist() == [names.of(w) + main_text.IN_ARTICLE * i for w in b.text.split()]
                                    for b, (s, e), i in zip(found, at, inside, strict=True))
    assert list(main_text.unpacked(main_text.pa.table(main_text.packed([found, [], found])))) == [found, [], found]


def test_runs_see_a_cards_story_on_its_own_page(spark):
    rng = random.Random(8)
    stories = [paragraphs(rng, 3) for _ in range(12)]
    notice = paragraphs(rng, 1, 12)
    made = [(i, f"http://h/{i}", page(article(s + notice * (i < 4)), f"<title>{i}</title>")) for i, s in enumerate(stories)]
    made.append((100, "http://h/100", page(article(stories[0]) + article(paragraphs(rng, 1)))))  # a story beside less of the page's own stays
    own = paragraphs(rng, 4)
    made.append((101, "http://h/101", page(article(own) + article(stories[7][:1]))))  # the card is on no other page with several articles
    made.append((102, "http://other/", page(article(own) + article(stories[7][:1]))))
    got = texts_of(spark, made)
    assert got[101]["text"] == "\n\n".join(own) and (got[101]["n_repeated"], got[101]["n_shared"]) == (30, 0)
    assert got[102]["text"] == "\n\n".join(own + stories[7][:1])
    assert got[100]["text"].startswith("\n\n".join(stories[0])) and got[100]["n_repeated"] == 90
    for i, story in enumerate(stories):  # the only article stays whole, what others have of it is told
        assert got[i]["text"] == "\n\n".join(story + notice * (i < 4)) and got[i]["n_repeated"] == 0
        assert got[i]["n_shared"] == 12 * (i < 4) + {0: 90, 7: 30}.get(i, 0)


@pytest.mark.parametrize("share", [0.01, 0.2])
def test_parts_of_a_host_change_nothing(spark, monkeypatch, share):
    rng = random.Random(11)
    notices = [paragraphs(rng, 1, 20) for _ in range(30)]
    made = []
    for i in range(120):
        _, url, html, _ = unnamed(i, rng)
        made += [(i, url, html), (i + 1000, url + "?x", html)] if i % 5 == 0 else [(i, url, html)]
        made.append((i + 2000, url, page(article(paragraphs(rng, 2) + rng.choice(notices) + notices[i % 3 * 10 + i % 2]))))
    made += made[:3] + [(None, "http://h.example", None)] * 2
    df = spark.createDataFrame(made, PAGES)
    monkeypatch.setattr(main_text, "HOT_SIZE", 1 << 40)
    whole = sorted(map(repr, main_text.main_text(df, share=share, part_tokens=1 << 40).collect()))
    monkeypatch.setattr(main_text, "HOT_SIZE", 20_000)
    monkeypatch.setattr(main_text, "HOT_PARTS", 1 << 40)
    assert sorted(map(repr, main_text.main_text(df, share=share).collect())) == whole
    assert sorted(map(repr, main_text.main_text(df, share=share, part_tokens=200).collect())) == whole
