"""Text and URL Column expressions. All of them are built-in functions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c\xa0"
_MARK = "\x1f "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def lower_trim(c: Column) -> Column:
    return F.lower(trim_blanks(c))


def upper_trim(c: Column) -> Column:
    return F.upper(trim_blanks(c))


def title_case(c: Column) -> Column:
    """Capital letter at every word start, where any non-word character ends a word.

    ``initcap`` only looks at spaces, so each word start gets a marker that ends
    in a space, and the marker is taken out again.
    """
    marked = F.regexp_replace(lower_trim(c), r"(?U)\b(?=\w)", _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def squeeze(c: Column) -> Column:
    """One space between words, none at the ends, empty text for null."""
    return F.coalesce(trim_blanks(F.regexp_replace(c, r"[\s\xa0]+", " ")), F.lit(""))


def contains_any(c: Column, *needles: str) -> Column:
    """Case-insensitive substring test against any of the needles."""
    low = F.lower(c)
    hit = low.contains(needles[0].lower())
    for needle in needles[1:]:
        hit = hit | low.contains(needle.lower())
    return hit


def icontains(c: Column, needle: str) -> Column:
    """Case-insensitive match of a keyword, where % and _ stay wildcards."""
    return c.ilike(f"%{needle}%")


def strip_tags(c: Column) -> Column:
    """Text without markup, scripts and style sheets; ``&nbsp;`` and runs of blanks become one space."""
    shown = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")
    return squeeze(F.replace(F.regexp_replace(shown, r"<[^>]*>?", ""), F.lit("&nbsp;"), F.lit(" ")))


def cut_at(url: Column, marker: str) -> Column:
    return F.substring_index(url, marker, 1)


def last_segment(url: Column) -> Column:
    """Last path segment without trailing slashes and without ``.html``."""
    tail = F.substring_index(F.regexp_replace(url, r"/+$", ""), "/", -1)
    return F.regexp_replace(tail, r"\.html$", "")


def http_url(url: Column) -> Column:
    """Web addresses with scheme and host in lower case; null for anything else."""
    clean = trim_blanks(url)
    origin = F.regexp_extract(clean, r"^(?i)(https?://[^/?#\s]+)", 1)
    rest = F.substr(clean, F.length(origin) + 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(origin != "", F.concat(F.lower(origin), path))


def surrogate_key(*parts: Column) -> Column:
    """Upper-hex md5 of the parts joined by ``|``; null when a part is null."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit("|"), part)
    return F.upper(F.md5(joined))


def ellipsis(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last an ellipsis when text was cut."""
    filled = F.coalesce(F.nullif(c, F.lit("")), F.lit("N/A"))
    return F.when(F.length(filled) <= limit, filled).otherwise(
        F.concat(F.substring(filled, 1, limit - 1), F.lit("…"))
    )


def _folding_table() -> tuple[str, str]:
    """Every character whose canonical form is one ASCII letter or digit plus accents."""
    source, target = ["đ"], ["d"]
    for code in range(0x80, min(sys.maxunicode, 0xFFFF)):
        base = [
            ch
            for ch in unicodedata.normalize("NFD", chr(code))
            if not 0x300 <= ord(ch) <= 0x36F
        ]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum() and base[0] == base[0].lower():
            source.append(chr(code))
            target.append(base[0])
    return "".join(source), "".join(target)


_FOLD_FROM, _FOLD_TO = _folding_table()


def fold_accents(c: Column) -> Column:
    """Lower case without accents (exact for single characters of the basic plane)."""
    plain = F.translate(F.lower(c), _FOLD_FROM, _FOLD_TO)
    return F.regexp_replace(plain, "[\u0300-\u036f]", "")


def slug(c: Column) -> Column:
    """ASCII slug of a name: ``Techcombank (TCB)`` gives ``techcombank-tcb``."""
    dashed = F.regexp_replace(fold_accents(c), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")
