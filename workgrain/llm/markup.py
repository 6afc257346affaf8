"""Helpers for one page: its blocks of text in order, each with what its surroundings say about it."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

# Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes noscript xmp".split())
BLOCK_LEVEL = frozenset(
    "address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary "
    "table tbody textarea tfoot thead title tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_TEXT = frozenset("head script style textarea title iframe noembed noframes noscript xmp template svg object canvas audio video select button".split())
FURNITURE = frozenset("nav aside footer menu dialog search".split())

# Names that authors give to the parts of a page, as words of class and id.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription paywall signup login menu nav navbar navigation breadcrumb breadcrumbs pagination "
    "pager sidebar sidebars aside footer share sharing social related recommended recommendations widget widgets toolbar skip masthead "
    "topbar copyright".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE_NAMES = frozenset(
    "article article-body article-content article-text articlebody post post-body post-content entry entry-content story story-body "
    "story-content main-content".split())

OPEN, MAIN, ARTICLE, HEADER, SOFT, HARD = range(6)  # what an element says: nothing; page's main part; article; its header; furniture

_TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass
class Block:
    """Text between two block-level tags."""

    said: int
    heading: bool
    text: str
    tags: list[str] = field(default_factory=list)  # block-level tags between the block before and this one
    article: int = 0  # which of the page's outermost article elements it is in, from 1


def tokens(page: str):
    """(kind, name, rest) of a page in order: 'text', 'start' and 'end'; comments, declarations and raw content are left out."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        follow = page[lt + 1 : lt + 2]
        if follow == "!" or follow == "?":
            comment = page.startswith("<!--", lt)
            end = page.find("-->" if comment else ">", lt + 4 if comment else lt)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        tag = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if tag is None:
            name = page[lt + 1 : lt + 3].lstrip("/")[:1]
            if name.isascii() and name.isalpha():  # a tag that never ends
                return
            yield "text", "<", ""
            at = lt + 1
            continue
        at, name = tag.end(), tag[1].lower()
        if follow == "/":
            yield "end", name, ""
            continue
        yield "start", name, tag[2]
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = close.start() if close else size


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def said_by(tag: str, text: str, around: int) -> int:
    """What an element says about its text, given what the elements around it say."""
    if around == HARD:
        return HARD
    if tag in NEVER_TEXT or tag in FURNITURE:
        return HARD
    found = attributes(text) if "=" in text or "hidden" in text else {}
    named = f"{found.get('class', '')} {found.get('id', '')}"
    words = set(_WORD.findall(_CAMEL.sub(" ", named).lower())) if named != " " else frozenset()
    role = found.get("role", "").lower()
    whole = tag in ("html", "body")
    if not whole and (words & COMMENTS or "hidden" in found or found.get("aria-hidden") == "true"
                      or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE)):
        return HARD
    if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    if tag == "main" or role == "main":
        return max(MAIN, around) if around in (OPEN, MAIN, ARTICLE) else MAIN
    if around in (ARTICLE, HEADER) and tag in HEADINGS:
        return ARTICLE
    if tag == "header" or (words & {"header"} and not whole):
        return HEADER if around in (ARTICLE, HEADER) else SOFT
    if tag == "form" or role in FURNITURE_ROLES or (not whole and words & FURNITURE_NAMES):
        return SOFT
    if around == SOFT:
        return SOFT
    if around in (OPEN, MAIN) and not whole and any(
            re.sub(r"[-_]+", "-", n.lower()) in ARTICLE_NAMES for n in named.split()):
        return ARTICLE
    return around


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks. Character references are decoded, white space inside a block is one space."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []
    there: Counter[str] = Counter()
    now, article, articles, heading, parts, tags = OPEN, 0, 0, 0, [], []

    def cut(name: str) -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(Block(now, heading > 0, text, tags.copy(), article))
            tags.clear()
        tags.append(name)

    def leave(at: int) -> None:
        nonlocal now, article, heading
        for tag, _, _ in stack[at:]:
            there[tag] -= 1
            heading -= tag in HEADINGS
        del stack[at:]
        now, article = stack[-1][1:] if stack else (OPEN, 0)

    for kind, name, rest in tokens(page):
        if kind == "text":
            parts.append(unescape(name) if "&" in name else name)
        elif name == "br":
            parts.append(" ")
        elif kind == "start":
            if name in BLOCK_LEVEL:
                cut(name)
            elif name in ("td", "th", "img", "input"):
                parts.append(" ")
            if name in VOID:
                continue
            now = said_by(name, rest, now)
            if name == "article" and now == ARTICLE and not article:
                article = articles = articles + 1
            stack.append((name, now, article))
            there[name] += 1
            heading += name in HEADINGS
        else:
            if name in BLOCK_LEVEL:
                cut("/" + name)
            elif name in ("td", "th"):
                parts.append(" ")
            if not there[name]:
                continue
            at = len(stack) - 1
            while stack[at][0] != name:
                at -= 1
            if name in BLOCK_LEVEL or name in ("td", "th") or not any(t in BLOCK_LEVEL for t, _, _ in stack[at + 1 :]):
                leave(at)
            else:  # an inline element that ends inside a block opened after it
                there[name] -= 1
                del stack[at]
    cut("")
    return out
