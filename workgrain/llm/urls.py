"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

Scoring is DataFrame functions only. The regression is fitted on the driver from a small labelled table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (verdict, host, path) rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Hand-labelled urls, 1 to block and 0 to allow, written around the names of the given pages (see README).
LABELLED = tuple((1, u) for u in (
    "https://casino-win.example/play", "http://www.casino-royal.test/slots", "https://best-casino.test/bonus",
    "https://online-casino.example/en/1", "http://m.casino-win.test/en/22.html", "https://blog.casino-city.test/en/771",
    "https://free-bets.example/odds", "http://www.free-bets.test/en/8", "https://sports-bets.test/de/12",
    "https://m.free-bets.test/es/19?page=2", "http://bets-now.example/fr/4", "https://blog.free-bets.test/en/90",
    "https://cheap-pills.example/buy", "http://www.cheap-pills.test/en/31", "https://diet-pills.test/order",
    "https://blog.cheap-pills.test/fr/7", "http://m.pills-online.test/es/5", "https://pills-shop.example/de/3",
    "https://spam-farm.example/a", "http://m.spam-farm.test/en/66", "https://www.spam-mail.test/en/9",
    "https://blog.spam-farm.test/de/17", "http://link-farm.example/fr/23", "https://spam-links.test/es/41",
    "https://ads-track.example/px", "http://www.ads-track.test/en/5", "https://ads-server.test/click",
    "https://m.ads-track.test/fr/71", "http://track-ads.example/es/8", "https://blog.ads-click.test/en/64",
    "https://adult-x.example/v", "http://www.adult-x.test/en/13", "https://adult-cam.test/live",
    "https://m.adult-x.test/de/27", "http://blog.adult-video.example/fr/6", "https://adult-dating.test/es/55",
    "https://xxx-tube.test/v/9", "http://porn-video.example/watch", "https://payday-loan.test/apply",
    "https://www.quick-loans.example/en/3", "http://replica-watch.test/shop", "https://free-money.example/win",
)) + tuple((0, u) for u in (
    "https://news.example/en/1", "http://www.library.test/en/31", "https://blog.science.example/en/771",
    "https://university.test/research", "http://m.weather.test/de/12", "https://museum.example/fr/4",
    "https://city-hall.test/es/19?page=2", "https://www.recipes.test/en/90", "http://blog.travel.test/fr/7",
    "https://thering.example/en/8423", "https://tionble.test/en/22.html", "http://www.hering.test/de/17",
    "https://m.thand.example/en/66", "http://blog.ertion.test/es/41", "https://onthe.example/fr/71",
    "https://www.thatre.test/en/13", "https://inger.test/de/27", "http://entis.example/es/55",
    "https://statement.test/en/5", "https://www.nation.example/en/9", "http://m.thirteen.test/en/64",
    "https://docs.example/guide", "http://www.python-docs.test/tutorial", "https://open-data.test/en/3",
    "https://health-care.example/en/8", "http://www.school.test/de/3", "https://street-map.test/es/8",
    "https://blog.garden.test/fr/23", "https://m.music.example/fr/6", "http://history.test/en/90.html",
    "https://encyclopedia.example/wiki", "https://www.train-times.test/de/4", "http://book-club.example/en/2",
    "https://m.radio.test/es/5", "https://blog.kitchen.example/en/17", "https://mountain.test/en/44/",
    "http://www.theatre.example/fr/13", "https://river.test/en/36472", "https://art-school.example/de/8",
    "https://blog.thened.test/en/28653", "https://m.therens.example/fr/1821", "https://tionshed.test/es/7266",
))

BUCKETS = 4096
SIZES = (3, 4, 5)


@dataclass
class UrlModel:
    """One weight for each gram bucket and an offset; log odds = offset + sum of weights / sqrt(grams)."""

    weights: list[float]
    offset: float


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for a null url or one without ://."""
    host = F.regexp_extract(_after(url), r"^([^/?#]*)", 1)
    return F.translate(host, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end; empty as for the host."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def grams(host: Column, path: Column, sizes: Sequence[int] = SIZES) -> Column:
    """Character n-grams of host and of path; a marker keeps the two kinds apart."""
    return F.concat(*(_windows(kind, text, n) for kind, text in (("h", host), ("p", path)) for n in sizes))


def _windows(kind: str, text: Column, n: int) -> Column:
    starts = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat(F.lit(kind), F.substring(text, i, F.lit(n))))


def bucket(gram: Column) -> Column:
    """First three hexadecimal digits of the md5: 0 to 4095."""
    return F.conv(F.substring(F.md5(gram.cast("binary")), 1, 3), 16, 10).cast("int")


def _local_buckets(host: str, path: str) -> list[int]:
    return [int(hashlib.md5((k + t[i : i + n]).encode()).hexdigest()[:3], 16)
            for k, t in (("h", host), ("p", path)) for n in SIZES for i in range(len(t) - n + 1)]


def fit(labelled: Iterable[tuple[int, str, str]], rounds: int = 400, rate: float = 4.0, ridge: float = 2e-3) -> UrlModel:
    """Gradient descent over (label, host, path) rows; no rows give a model with log odds 0 everywhere."""
    rows = list(labelled)
    x = np.zeros((len(rows), BUCKETS))
    y = np.array([r[0] for r in rows], dtype=float)
    for i, (_, host, path) in enumerate(rows):
        found = _local_buckets(host, path)
        np.add.at(x[i], found, 1 / np.sqrt(max(1, len(found))))
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(rounds if rows else 0):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ miss / len(rows) + ridge * w)
        b -= rate * float(miss.mean())
    return UrlModel([round(float(v), 9) for v in w], round(b, 9))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most: int = 10_000) -> UrlModel:
    """Fit on a small labelled table: rows with a null url or a label other than 0 and 1 teach nothing.

    More than ``most`` rows are refused, not cut.
    """
    rows = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int"), host_of(F.col(url_col)), path_of(F.col(url_col)))
    got = [tuple(r) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"the labelled table has more than {most} rows")
    return fit(sorted(got))


def default_model(spark) -> UrlModel:
    return train(spark.createDataFrame(list(LABELLED), "label int, url string"))


def block_odds(host: Column, path: Column, model: UrlModel) -> Column:
    """Probability that the url is to be blocked; 0 without any gram."""
    found = F.transform(grams(host, path), bucket)
    weights = F.split(F.lit(",".join(map(repr, model.weights))), ",").cast("array<double>")
    total = F.aggregate(found, F.lit(0.0), lambda s, i: s + F.element_at(weights, i + 1))
    n = F.size(found)
    odds = F.lit(model.offset) + total / F.sqrt(n.cast("double"))
    return F.when(n > 0, 1 / (1 + F.exp(-odds))).otherwise(0.0)


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = RULES, url_col: str = "url",
          cut: float = 0.5) -> DataFrame:
    """Every row with ``host``, ``path``, ``rule``, ``verdict`` and ``block_odds``; such columns are replaced.

    A rule (verdict, host, path) fits its host and all subdomains if the path starts with the rule's;
    the longest fitting rule decides, of equal lengths the one with the longer host, then the first by
    name. Without a rule the model decides: block from ``cut`` on. A url that is null, or without ://,
    has empty host and path, fits no rule and is allowed. Rows may repeat; none is dropped. The rules
    are a parameter and become one CASE expression.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_odds")]
    split = pages.select(*kept, host_of(F.col(url_col)).alias("__host"), path_of(F.col(url_col)).alias("__path"))
    host, path = F.col("__host"), F.col("__path")
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        rule = F.when(fits, F.lit(at + start)).otherwise(rule)
        said = F.when(fits, F.lit(verdict)).otherwise(said)
    odds = split.select(*kept, host.alias("host"), path.alias("path"), rule.alias("rule"), said.alias("__said"),
                        block_odds(host, path, model).alias("block_odds"))
    method = F.when(F.col("block_odds") >= cut, "block").otherwise("allow")
    return odds.select(*kept, "host", "path", "rule", F.coalesce("__said", method).alias("verdict"), "block_odds")


def oracle(pages: str = "pages") -> str:
    """DuckDB SQL for the query's rows, with the fitted weights written out."""
    labelled = [(label, u.split("://")[1].partition("/")[0], "/" + u.split("://")[1].partition("/")[2].split("?")[0])
                for label, u in LABELLED]
    model = fit(sorted(labelled))
    pieces = " || ".join(
        f"list_transform(range(1, greatest(1, length({t}) - {n - 2})), lambda i: '{k}' || substr({t}, i, {n}))"
        for k, t in (("h", "host"), ("p", "path")) for n in SIZES)
    whens = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in whens]
    return f"""
    WITH split AS (
      SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail
      FROM {pages}
    ), parts AS (
      SELECT page_id, translate(regexp_extract(tail, '^([^/?#]*)', 1), '{ascii_uppercase}', '{ascii_lowercase}') AS host,
        regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path
      FROM split
    ), urls AS (SELECT DISTINCT host, path FROM parts
    ), found AS (SELECT host, path, {pieces} AS g FROM urls
    ), weights AS (SELECT unnest({model.weights}) AS w, unnest(range({BUCKETS})) AS i
    ), odds AS (
      SELECT host, path, {model.offset!r} + sum(w) / sqrt(count(*)) AS z
      FROM (SELECT host, path, CAST('0x' || substr(md5(unnest(g)), 1, 3) AS INTEGER) AS i FROM found) JOIN weights USING (i)
      GROUP BY host, path
    )
    SELECT page_id, p.host, p.path,
      CASE {' '.join(f"WHEN {c.replace('host', 'p.host').replace('path', 'p.path')} THEN '{r}'" for c, r, _ in fits)} END AS rule,
      CASE {' '.join(f"WHEN {c.replace('host', 'p.host').replace('path', 'p.path')} THEN '{v}'" for c, _, v in fits)}
        WHEN coalesce(z, -1) >= 0 THEN 'block' ELSE 'allow' END AS verdict
    FROM parts p LEFT JOIN odds o ON p.host = o.host AND p.path = o.path
    """
