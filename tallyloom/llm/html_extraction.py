"""Main text of web pages by nearest-URL page differencing.

Every page becomes a sequence of text lines, one for each block of its markup.  Pages are sorted by host and
URL path, and each is paired with the neighbour whose path shares the longest beginning.  The two sequences
are aligned by longest common subsequence, and lines that both share are the site's, not the page's: they
go.  Markup settles what a comparison of two pages cannot: lines inside navigation, footers, forms and the
like go even if the neighbour differs there, and lines of an article stay even if the neighbour repeats them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, id_text, overlapping_blocks, stored, with_ids, with_rank

# Element names of HTML.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
DROPPED = {
    "head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "svg", "math", "button", "select", "option", "textarea",
    "input", "iframe", "object", "embed", "canvas", "audio", "video", "dialog", "menu", "title", "xmp", "noembed", "noframes",
}
MAIN = {"article", "main"}
#: Words of a class, an id or a role that mark what is not part of an article.
BOILERPLATE = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "contentinfo", "cookie", "cookies", "consent", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "pagination", "pager", "popup", "promo", "promotion", "related", "respond", "search", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that may stand before, or after, one of those in a compound, as in ``site-header`` and ``comment-list``.
BEFORE = {"site", "page", "main", "top", "bottom", "left", "right", "global", "post", "article", "entry", "blog"}
AFTER = {"list", "box", "area", "block", "container", "wrapper", "wrap", "bar", "section", "links", "item", "form", "slot", "unit", "button", "buttons", "posts", "articles", "inner", "thread", "body"}
#: What no article can be inside of; in other boilerplate, a wrapper of the whole page for one, it can.
NEVER = {"ad", "ads", "adv", "advert", "advertisement", "advertising", "comment", "comments", "disqus", "respond", "related", "sponsor", "sponsored", "promo", "promotion"}
#: Elements whose class counts inside an article; that of a paragraph or a heading does not.
CONTAINERS = {"div", "section", "aside", "ul", "ol", "dl", "table", "nav", "header", "footer"}
#: Those that inside an article may hold its heading.
HEADINGS = {"header", "masthead", "banner"}
#: Elements that end when another of their group begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_MARK = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
_UNSEEN = re.compile(r"aria-hidden\s*=\s*[\"']?true|(?<![\w-])style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

GONE, MAINLY, OPEN, WRAPPED = 0, 1, 2, 3


def boilerplate_words(token: str) -> set[str]:
    """The words of a class or id that make it boilerplate: all its parts are such words or go with them."""
    parts = re.split("[-_]+", token.lower())
    rest = parts[1:] if len(parts) > 1 and parts[0] in BEFORE else parts
    found = BOILERPLATE.intersection(rest)
    return found if all(p in BOILERPLATE or p in AFTER for p in rest) else set()


def _kind(name: str, attributes: str, kind: int) -> int:
    if kind == GONE or name in DROPPED or (name == "header" and kind != MAINLY):
        return GONE
    inner = MAINLY if name in MAIN else kind
    if attributes:
        for mark in _MARK.finditer(attributes):
            value = mark[2] or mark[3] or mark[4] or ""
            if mark[1].lower() == "role" and value.lower() in MAIN:
                return MAINLY
            if name in ("html", "body") or kind == MAINLY and name not in CONTAINERS:
                continue
            words = set().union(*map(boilerplate_words, value.split())) - (HEADINGS if kind == MAINLY else set())
            if words & NEVER or words and (kind == MAINLY or name in MAIN):
                return GONE
            if words:
                inner = WRAPPED
        if _HIDDEN.search(_VALUE.sub("=", attributes)) or _UNSEEN.search(attributes):
            return GONE
    return inner


def lines_of(html: str | None) -> list[tuple[str, int]]:
    """The text lines of a page, in order: a line for each run of text that no block's edge divides.

    Each comes with its kind: inside an element that is no part of an article, inside an article, or open.
    References are decoded and white space is one blank.
    """
    html = html or ""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()  # names in the stack, so that a tag that closes nothing looks for nothing
    kind, at, end = OPEN, 0, len(html)

    def close_from(k: int) -> None:
        opened.subtract(x for x, _ in stack[k:])
        del stack[k:]

    def flush() -> None:
        if held:
            if line := " ".join(unescape("".join(held)).split()):
                out.append((line, kind))
            held.clear()

    while at < end:
        token = _TOKEN.search(html, at)
        if token is None:
            held.append(html[at:])
            break
        if token.start() > at:
            held.append(html[at : token.start()])
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue  # a comment or a declaration
        name, closing = name.lower(), bool(token[1] or token[4])
        inline = name in INLINE
        if not inline:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[k][0] == name:
                    if kind != stack[k][1]:
                        flush()
                    kind = stack[k][1]
                    close_from(k)
                    break
                if inline and stack[k][0] not in INLINE:
                    break  # it closes nothing of this block
            continue
        attributes = token[3] or token[6] or ""
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in VOID or attributes.endswith("/") and name not in MAIN and not attributes[:-1].strip():
            continue
        if (ended := CLOSES.get(name)) is not None:
            for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):
                if stack[k][0] in ended:
                    kind = stack[k][1]
                    close_from(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        inner = _kind(name, attributes, kind)
        if inner != kind:
            flush()
        stack.append((name, kind))
        opened[name] += 1
        kind = inner
    flush()
    return out


# --- longest common subsequence --------------------------------------------------------------------------


def _rows(a: list[int], b: list[int]) -> list[int]:
    """After each item of ``a``: a bit for every item of ``b``, 0 where the common length rises."""
    places: dict[int, int] = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full, v, out = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(row: int, n: int) -> np.ndarray:
    zeros = np.unpackbits(np.frombuffer((~row & ((1 << n) - 1)).to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.r_[0, np.cumsum(zeros, dtype=np.int64)]


def common_lines(a: list[int], b: list[int], most_bits: int = 1 << 28) -> list[int]:
    """Positions in ``a`` of one longest common subsequence of ``a`` and ``b``; long pairs are halved."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    both = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    where = [i for i in range(head, len(a) - tail) if a[i] in both]
    x, y = [a[i] for i in where], [b[j] for j in range(head, len(b) - tail) if b[j] in both]
    if x and len(x) * len(y) > most_bits and len(x) > 1:
        half = len(x) // 2
        first, second = _lengths(_rows(x[:half], y)[-1], len(y)), _lengths(_rows(x[half:][::-1], y[::-1])[-1], len(y))
        cut = int((first + second[::-1]).argmax())
        middle = common_lines(x[:half], y[:cut], most_bits) + [half + k for k in common_lines(x[half:], y[cut:], most_bits)]
    else:
        rows, middle, j = _rows(x, y), [], len(y) - 1
        for i in range(len(x) - 1, -1, -1):
            while j >= 0 and rows[i] >> j & 1:
                j -= 1  # the length does not rise here
            if j < 0:
                break
            if i and not rows[i - 1] >> j & 1:
                continue  # it rises without this line too
            middle.append(i)
            j -= 1
        middle.reverse()
    return [*range(head), *(where[k] for k in middle), *range(len(a) - tail, len(a))]


# --- pages -----------------------------------------------------------------------------------------------


def place_of(url: str | None) -> tuple[str, str]:
    """Host and path of a URL; a last slash, an index page's name and an extension don't count."""
    try:
        found = urlsplit((url or "").strip())
        host, path = (found.hostname or ""), found.path
    except ValueError:
        host, path = "", url or ""
    return host, re.sub(r"(?:/index)?(?:\.[a-z0-9]{1,5})?/*$", "", path.lower())


def _shared(line_hashes: np.ndarray, other: np.ndarray) -> np.ndarray:
    gone = np.zeros(len(line_hashes), bool)
    gone[common_lines(line_hashes.tolist(), other.tolist())] = True
    return gone


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def main_text(lines: list[str], kinds: np.ndarray, shared: np.ndarray) -> str:
    """What is left of a page, given the lines that its neighbour has too.

    If nothing of a page without an article would be left, the two are copies and nothing is taken for
    the site's.
    """
    if (kinds == MAINLY).any():
        keep = kinds == MAINLY
    else:
        keep = (kinds == OPEN) & ~shared
        if not keep.any():
            keep = kinds == OPEN
    return " ".join(x for x, k in zip(lines, keep.tolist(), strict=True) if k)


PARSED = "key long, host string, path string, page_id string, url string, lines binary, kinds binary, hashes binary"
#: Pages in the order of host and path that one task compares.
BLOCK = 2000


def _parsed(pages: DataFrame) -> DataFrame:
    """``key`` and the rest of ``PARSED``: a page's place, its lines, their kinds and hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        squeeze = zstandard.ZstdCompressor(level=6)
        for pdf in batches:
            rows = []
            for key, own_id, own_url, own_html in zip(pdf["key"], pdf["page_id"], pdf["url"], pdf["html"], strict=True):
                lines = lines_of(own_html)
                kept = [x if kind in (MAINLY, OPEN) else "" for x, kind in lines]
                hashes = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x, _ in lines], np.uint64)
                rows.append((key, *place_of(own_url), own_id, own_url, squeeze.compress("\n".join(kept).encode("utf-8", "surrogatepass")), bytes(k for _, k in lines), hashes.tobytes()))
            yield pd.DataFrame(rows, columns=["key", "host", "path", "page_id", "url", "lines", "kinds", "hashes"])

    return pages.withColumn("key", F.monotonically_increasing_id()).mapInPandas(run, PARSED).withColumn("page_id", F.col("page_id").cast("long"))


def _compared(ranked: DataFrame) -> DataFrame:
    """``key, shared``: a bit for each line of a page that its partner has too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values("rank").itertuples(index=False))
        out = []
        for k, page in enumerate(rows):
            if not page.own:
                continue
            partners = [x for x in (*rows[max(k - 1, 0) : k], *rows[k + 1 : k + 2]) if x.host == page.host]
            partners.sort(key=lambda x: -_alike(x.path, page.path))
            # A copy of the page tells nothing about the site, if the other neighbour is none.
            partners.sort(key=lambda x: x.hashes == page.hashes)
            mine = np.frombuffer(page.hashes, np.uint64)
            shared = _shared(mine, np.frombuffer(partners[0].hashes, np.uint64)) if partners else np.zeros(len(mine), bool)
            out.append((page.key, np.packbits(shared).tobytes()))
        return pd.DataFrame(out, columns=["key", "shared"])

    return overlapping_blocks(ranked, BLOCK, 1).groupBy("block").applyInPandas(run, "key long, shared binary")


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_shared`` for every row of ``pages``.

    ``text`` is the page's lines that stay, joined by one space, and empty if none do; ``n_chars`` counts
    its code points, ``n_shared`` the lines that its partner has too.  The partner is the page before or
    after in the order of host, path and id, whichever shares the longer beginning of the path; a page
    alone with its host has none.

    Null and empty pages give the empty text, null URLs are a host of their own, pages without any markup
    are one line.  Repeated rows each get their row; an empty table gives an empty result; further columns
    are ignored whatever their names.  Pages are compared by hashes of their lines, in blocks of the order
    that overlap, so the result depends on no partitioning and a host may have any number of pages.
    """
    bounded_batches(pages.sparkSession)
    narrow = pages.select(id_text(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    parsed = stored(_parsed(narrow), "pages")
    ranked = with_rank(parsed.select("key", "host", "path", "page_id", "hashes"), ["host", "path", "page_id", "key"])
    compared = stored(_compared(ranked), "compared-pages")
    discard(ranked)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        expand = zstandard.ZstdDecompressor()
        for pdf in batches:
            rows = []
            for page in pdf.itertuples(index=False):
                lines = expand.decompress(page.lines).decode("utf-8", "surrogatepass").split("\n") if page.kinds else []
                kinds = np.frombuffer(page.kinds, np.uint8)
                shared = np.unpackbits(np.frombuffer(page.shared, np.uint8), count=len(kinds)).astype(bool)
                text = main_text(lines, kinds, shared)
                rows.append((page.url, text, len(text), int(shared.sum())))
            out = pd.DataFrame(rows, columns=["url", "text", "n_chars", "n_shared"])
            out.insert(0, "page_id", pdf["page_id"].to_numpy())
            yield out

    both = parsed.select("key", id_text("page_id").alias("page_id"), "url", "lines", "kinds").join(compared, "key").drop("key")
    return with_ids(both.mapInPandas(finish, "page_id string, url string, text string, n_chars long, n_shared long"), "page_id")
