"""Markup in one pass: links with their texts, assets and refreshes, as a browser's parser would find them.

A scanner walks the text once from ``<`` to ``<``: names, attributes and quoted values are taken where they stand, and
every step starts where the one before ended, so a page takes time in proportion to its length, however broken it is.

What it follows: a tag that never ends is none; quotes hold ``>``; the first of two attributes of one name counts;
comments, and what stands in scripts, styles, titles and text areas, have no tags. An anchor with ``href`` is open until
its end tag, the next anchor or the end of the text, so anchors that aren't closed are links with the text up to there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import pieces

#: What counts as a blank at the ends of a line or an address.
BLANKS = " \t\n\v\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Elements whose content is text up to their end tag.
RAW = ("script", "style", "title", "textarea", "xmp", "noembed", "noframes", "iframe")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_SKIP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_URL_OF_REFRESH = re.compile(r".*url\s*=\s*([^\"'>\s]+)", re.I | re.S)  # the last one counts

LINK = "struct<url:string,text:string,source:string>"
#: In this order: anchors, images, forms, backgrounds, other assets, refreshes.
SOURCES = ("html:a", "html:img", "html:form", "html:bg", "html:asset", "html:refresh")


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on and the place behind the tag; -1 if it doesn't end."""
    out: dict[str, str] = {}
    while True:
        at = _SKIP.match(html, at).end()
        if at >= len(html):
            return out, -1
        if html[at] == ">":
            return out, at + 1
        key = _KEY.match(html, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            if html[at : at + 1] in ('"', "'") and at < len(html):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return out, -1
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        out.setdefault(key[0].lower(), value)


def tags(html: str) -> Iterator[tuple[str, object, int]]:
    """(name, attributes, place behind it) of each start tag, ("/name", None, place) of each end tag, ("", text, place) of
    the text between."""
    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield "", html[at:], n
            return
        if lt > at:
            yield "", html[at:lt], lt
        after = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif after in ("!", "?") or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
            end = html.find(">", lt)
            at = n if end < 0 else end + 1
        elif after == "/":
            name = _NAME.match(html, lt + 2)
            end = html.find(">", lt) if name else -1
            if end < 0:
                return
            yield "/" + name[0].lower(), None, end + 1
            at = end + 1
        elif name := _NAME.match(html, lt + 1):
            attributes, end = _attributes(html, name.end())
            if end < 0:
                return
            at, tag = end, name[0].lower()
            yield tag, attributes, at
            if tag in _RAW_END:
                close = _RAW_END[tag].search(html, at)
                end = close.start() if close else n
                if end > at:
                    yield "", html[at:end], end
                at = end
        else:  # a sign of its own
            yield "", "<", lt + 1
            at = lt + 1


def _refresh(attributes: dict[str, str]) -> str | None:
    """Where a tag sends the reader by itself; what stands before ``http-equiv`` doesn't count."""
    names = list(attributes)
    if attributes.get("http-equiv", "").strip().lower() != "refresh" or "content" not in names[names.index("http-equiv") :]:
        return None
    url = _URL_OF_REFRESH.match(attributes["content"])
    return url[1] if url else None


def links_of(html: str | None) -> list[dict]:
    """url, text, source of what a page refers to, in order of ``SOURCES``, then of place; one refresh at most. Entities
    and blanks of texts are as they stand."""
    found: dict[str, list[dict]] = {s: [] for s in SOURCES}
    anchor: list[str] | None = None  # texts of the open one

    def close() -> None:
        nonlocal anchor
        if anchor is not None:
            found["html:a"][-1]["text"] = "".join(anchor) or None
            anchor = None

    def add(source: str, url: str, text: str | None) -> None:
        found[source].append({"url": url.strip(BLANKS), "text": text, "source": source})

    for name, what, _ in tags(html or ""):
        if name == "":
            if anchor is not None:
                anchor.append(what)
        elif name == "/a":
            close()
        elif what is not None:
            if name == "a":
                close()
                if what.get("href"):
                    add("html:a", what["href"], None)
                    anchor = []
            if name == "img" and what.get("src"):
                add("html:img", what["src"], "[img]")
            elif name == "form" and what.get("action"):
                add("html:form", what["action"], "[form]")
            elif name not in ("img", "form") and (own := [what[k] for k in what if k in ("src", "action") and what[k]]):
                add("html:asset", own[0], "[asset]")
            if what.get("background"):
                add("html:bg", what["background"], "[bg]")
            if not found["html:refresh"] and (url := _refresh(what)):
                add("html:refresh", url, "[meta refresh]")
    close()
    return [x for s in SOURCES for x in found[s]]


def page_links(html: Column) -> Column:
    """array<struct(url, text, source)> of a column of pages, in Arrow batches; none for null."""
    kind = pa.list_(pa.struct([(n, pa.string()) for n in ("url", "text", "source")]))

    @F.arrow_udf(f"array<{LINK}>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for own in (p for batch in batches for p in pieces(batch)):
            yield pa.array([links_of(x.as_py()) for x in own], kind)

    return scan(html)
