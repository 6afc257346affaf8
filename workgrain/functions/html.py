"""Small helpers that run inside page tasks: a tag tree, selectors, and an allow-list.

They only look at one page at a time; Spark partitions and shuffles the pages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache
from html import escape, unescape
from html.parser import HTMLParser
from urllib.parse import urlsplit

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Node:
    """An element with its parts (texts and elements); ``at`` and ``end`` number it and its last descendant in page order."""

    __slots__ = ("tag", "attrs", "classes", "parent", "parts", "at", "end")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.parent, self.parts = tag, parent, []
        self.attrs = attrs or {}
        self.classes = frozenset(self.attrs["class"].split()) if "class" in self.attrs else frozenset()
        self.at = self.end = 0

    def text(self):
        """Texts joined by one space; script and style parts are left out."""
        words, stack = [], list(reversed(self.parts))
        while stack:
            part = stack.pop()
            if isinstance(part, Node):
                if part.tag not in SILENT:
                    stack.extend(reversed(part.parts))
            else:
                words.extend(part.split())
        return " ".join(words)


_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style", "textarea", "title")}


def _attributes(text: str) -> dict[str, str]:
    """Attributes of a tag; the first of a repeated name counts."""
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def tree(page: str) -> Node:
    """The page's elements. An end tag closes the nearest open element of its name, one that is not open is ignored."""
    root = open_ = Node("")
    at, number, opened = 0, 0, {}
    while at < len(page):
        found = _MARKUP.search(page, at)
        if (end := found.start() if found else len(page)) > at:
            data = page[at:end]
            open_.parts.append(unescape(data) if "&" in data else data)
        if not found:
            break
        at = found.end()
        if name := found[2]:
            name, rest, number = name.lower(), found[3], number + 1
            node = Node(name, _attributes(rest) if rest else None, open_)
            node.at = number
            open_.parts.append(node)
            if name not in VOID and not rest.endswith("/"):
                open_ = node
                opened[name] = opened.get(name, 0) + 1
                if name in _RAW_END:
                    close = _RAW_END[name].search(page, at)
                    to = close.start() if close else len(page)
                    if to > at:
                        node.parts.append(page[at:to] if name in SILENT else unescape(page[at:to]))
                    at = to
            else:
                node.end = number
        elif (name := (found[1] or "").lower()) and opened.get(name):
            while True:
                node, open_ = open_, open_.parent
                node.end = number
                opened[node.tag] -= 1
                if node.tag == name:
                    break
    while open_ is not None:
        open_.end, open_ = number, open_.parent
    return root


_PART = re.compile(r"(?P<kind>[.#]?)(?P<name>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^]?=)['\"]?(?P<value>[^'\"\]]*)['\"]?)?\]")


class _Compound:
    """Tests one element has to pass: tag, id, classes, attributes."""

    __slots__ = ("tag", "ident", "classes", "attrs")

    def __init__(self, step: str):
        found = [m.groupdict() for m in _PART.finditer(step)]
        self.tag = next((t["name"] for t in found if t["name"] and not t["kind"]), None)
        self.ident = next((t["name"] for t in found if t["kind"] == "#"), None)
        self.classes = frozenset(t["name"] for t in found if t["kind"] == ".")
        self.attrs = [(t["attr"], t["op"], t["value"]) for t in found if t["attr"]]

    def fits(self, node: Node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        if self.classes and not self.classes <= node.classes:
            return False
        if self.ident and node.attrs.get("id") != self.ident:
            return False
        for name, op, want in self.attrs:
            have = node.attrs.get(name)
            if have is None or (op == "=" and have != want) or (op == "*=" and want not in have) or (
                op == "^=" and not have.startswith(want)
            ):
                return False
        return True


@lru_cache(maxsize=1024)
def _compiled(selector: str) -> list[list[_Compound]]:
    """Comma parts, each a list of compounds from the outermost inward."""
    steps = [re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", chain.strip()) for chain in selector.split(",")]
    return [[_Compound(step) for step in chain] for chain in steps]


def _matches(node: Node, chain: list[_Compound]) -> bool:
    if not chain[-1].fits(node):
        return False
    left, above = len(chain) - 2, node.parent
    while left >= 0 and above is not None:
        if chain[left].fits(above):
            left -= 1
        above = above.parent
    return left < 0


class Selectors:
    """A set of selectors, sorted by what their innermost step names, so that one walk finds the matches of all."""

    def __init__(self, selectors):
        self._by: dict[str, list] = {}
        self.names = list(dict.fromkeys(selectors))
        self.known: dict[str, _Tag] = {}
        for number, selector in enumerate(self.names):
            for chain in _compiled(selector):
                last = chain[-1]
                if last.classes:
                    key = "." + min(last.classes)
                elif last.ident:
                    key = "#" + last.ident
                else:
                    key = last.tag or "*"
                self._by.setdefault(key, []).append((number, chain))

    def tries(self, element: Node | _Tag) -> list:
        """(number of a selector, chain) of all that could choose an element, by what it is named."""
        by = self._by
        tries = list(by.get(element.tag, ()))
        for name in element.classes:
            tries += by.get("." + name, ())
        if "id" in element.attrs:
            tries += by.get("#" + element.attrs["id"], ())
        return [*tries, *by.get("*", ())]

    def find(self, root: Node) -> Matches:
        """Every selector's matches on a page, in page order."""
        found: list[list[Node]] = [[] for _ in self.names]
        stack = [p for p in reversed(root.parts) if isinstance(p, Node)]
        while stack:
            node = stack.pop()
            for number, chain in self.tries(node):
                here = found[number]
                if (not here or here[-1] is not node) and _matches(node, chain):
                    here.append(node)
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))
        return Matches(dict(zip(self.names, found, strict=True)))


class Matches:
    """The matches of a page by selector; those inside an element are a slice, by its place in the page."""

    def __init__(self, found: dict[str, list[Node]]):
        self._found = found
        self._at = {selector: [n.at for n in nodes] for selector, nodes in found.items()}

    def below(self, node: Node, selector: str) -> list[Node]:
        places = self._at[selector]
        return self._found[selector][bisect_right(places, node.at):bisect_right(places, node.end)]

    def first(self, node: Node, selector: str) -> Node | None:
        places = self._at[selector]
        at = bisect_right(places, node.at)
        return self._found[selector][at] if at < len(places) and places[at] <= node.end else None


class Hit:
    """An element that selectors chose, as ``read`` gives it: its attributes, its place in the page and its texts, but no tree."""

    __slots__ = ("tag", "attrs", "at", "end", "_texts", "_unseen", "_from", "_to", "_silent")

    def __init__(self, tag: _Tag, at: int, texts: list[str], unseen: dict[int, int], silent: int):
        self.tag, self.attrs, self.at, self.end = tag.name, tag.attrs, at, at
        self._texts, self._unseen, self._from, self._to, self._silent = texts, unseen, len(texts), len(texts), silent

    def text(self) -> str:
        """As ``Node.text``."""
        low, high = self._from, self._to
        if not self._unseen:
            return " ".join(" ".join(self._texts[low:high]).split())
        parts = [self._texts[i] for i in range(low, high) if self._unseen.get(i, 0) == self._silent]
        return " ".join(" ".join(parts).split())


class _Tag:
    """A tag as it is written: name, attributes, whether it closes or opens an element, and the chains whose last step it fits."""

    __slots__ = ("name", "tag", "attrs", "classes", "closes", "opens", "silent", "raw", "chains")

    def __init__(self, name: str, rest: str, closes: bool, selectors: Selectors):
        self.name = self.tag = name
        self.attrs, self.closes = _attributes(rest) if rest and not closes else {}, closes
        self.classes = frozenset(self.attrs["class"].split()) if "class" in self.attrs else frozenset()
        self.opens = not closes and name not in VOID and not rest.endswith("/")
        self.silent, self.raw = name in SILENT, _RAW_END.get(name) if self.opens else None
        self.chains = [] if closes else [(number, chain) for number, chain in selectors.tries(self) if chain[-1].fits(self)]


TAGS_KNOWN = 4096
_NONE = _Tag("", "", True, Selectors([]))


def read(page: str, selectors: Selectors) -> tuple[Hit, Matches]:
    """(the page, every selector's matches): what ``tree`` and ``Selectors.find`` give, in one pass that keeps the matches only.

    An element's ancestors are the open ones when its tag comes, so no tree is needed. A tag that is written alike was
    looked at before, up to TAGS_KNOWN of them. Nothing refers back to what holds it, so a page's memory is free at its end.
    """
    known, texts, unseen = selectors.known, [], {}
    root = Hit(_NONE, 0, texts, unseen, 0)
    found: list[list[Hit]] = [[] for _ in selectors.names]
    open_: list[_Tag] = []
    hits: list[Hit | None] = []
    at, number, silent, size = 0, 0, 0, len(page)

    def add(data: str) -> None:
        if silent:
            unseen[len(texts)] = silent
        texts.append(data)

    while at < size:
        for m in _MARKUP.finditer(page, at):
            start, end = m.span()
            if start > at:
                data = page[at:start]
                add(unescape(data) if "&" in data else data)
            at = end
            written = m[0]
            tag = known.get(written)
            if tag is None:
                closing, name, rest = m.groups()
                if not (name or closing):
                    continue
                if len(known) >= TAGS_KNOWN:
                    known.clear()
                tag = known[written] = _Tag((name or closing).lower(), rest, not name, selectors)
            if not tag.closes:
                number += 1
                hit, inner = None, silent + tag.silent
                for which, chain in tag.chains:
                    if len(chain) == 1 or _above(open_, chain):
                        if hit is None:
                            hit = Hit(tag, number, texts, unseen, inner)
                        here = found[which]
                        if not here or here[-1] is not hit:
                            here.append(hit)
                if tag.opens:
                    open_.append(tag)
                    hits.append(hit)
                    silent = inner
                    if tag.raw:
                        close = tag.raw.search(page, at)
                        to = close.start() if close else size
                        if to > at:
                            add(page[at:to] if tag.silent else unescape(page[at:to]))
                        at = to
                        break
            elif open_ and (open_[-1].name == tag.name or any(o.name == tag.name for o in open_)):
                while True:
                    closed, hit = open_.pop(), hits.pop()
                    silent -= closed.silent
                    if hit is not None:
                        hit.end, hit._to = number, len(texts)
                    if closed.name == tag.name:
                        break
        else:
            if at < size:
                data = page[at:]
                add(unescape(data) if "&" in data else data)
            break
    for hit in (root, *hits):
        if hit is not None:
            hit.end, hit._to = number, len(texts)
    return root, Matches(dict(zip(selectors.names, found, strict=True)))


def _above(open_: list[_Tag], chain: list[_Compound]) -> bool:
    left = len(chain) - 2
    for above in reversed(open_):
        if chain[left].fits(above):
            left -= 1
            if left < 0:
                return True
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that fit a selector of tags, classes, ids and attributes."""
    return Selectors([selector]).find(root).below(root, selector)


# Tags, link attributes and schemes that stay in cleaned descriptions.
ALLOWED_TAGS = frozenset(
    "p br hr strong b em i u s small mark ul ol li h1 h2 h3 h4 h5 h6 a span div blockquote "
    "code pre table thead tbody tr th td".split()
)
LINK_ATTRIBUTES = ("href", "title")
LINK_EXTRAS = (("target", "_blank"), ("rel", "noopener noreferrer nofollow"))
SCHEMES = ("http", "https", "mailto")
DROPPED = SILENT | {"button", "textarea", "option", "noscript"}


def _safe_link(value: str) -> bool:
    clean = re.sub(r"[\x00-\x20]+", "", value)
    if clean.startswith("//"):
        return False
    scheme = urlsplit(clean).scheme.lower() if re.match(r"[a-zA-Z][\w.+-]*:", clean) else ""
    return not scheme or scheme in SCHEMES


class _Cleaner(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.dropped, self.open = [], [], []

    def handle_starttag(self, tag, attrs):
        if self.dropped or tag in DROPPED:
            if tag in DROPPED:
                self.dropped.append(tag)
            return
        if tag not in ALLOWED_TAGS:
            return
        kept = ""
        if tag == "a":
            values = dict(attrs)
            pairs = [
                (k, values[k] or "") for k in LINK_ATTRIBUTES
                if k in values and (k != "href" or _safe_link(values[k] or ""))
            ]
            kept = "".join(f' {k}="{escape(v)}"' for k, v in (*pairs, *LINK_EXTRAS))
        if tag in VOID:
            self.out.append(f"<{tag}{kept} />")
        else:
            self.open.append(tag)
            self.out.append(f"<{tag}{kept}>")

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
            return
        if tag in self.open:
            while (last := self.open.pop()) != tag:
                self.out.append(f"</{last}>")
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.dropped:
            self.out.append(escape(data, quote=False))


def clean_html(fragment: str) -> str:
    """Allow-listed markup of a description, links marked as outgoing."""
    cleaner = _Cleaner()
    cleaner.feed(fragment)
    cleaner.close()
    cleaner.out.extend(f"</{tag}>" for tag in reversed(cleaner.open))
    return re.sub(r"\n\s*\n\s*\n", "\n\n", "".join(cleaner.out)).strip()
