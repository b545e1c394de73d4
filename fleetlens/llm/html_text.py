"""Main text of HTML pages by runs of tokens that repeat on a host.

A small parser cuts each page into blocks and notes the elements around them.  The tokens of
the blocks outside an article element are a page's stream.  The streams of a host, put one after
the other, make its suffix array; a run of ``RUN`` tokens or more that stands on distinct pages
of the host is boilerplate.  Its tokens are removed and unique runs are kept, in the page's order and beside an
article's blocks too.  The structural check that follows drops what markup calls a menu, header,
footer, sidebar, notice, advert, form or comments even if it stands on one page only, and keeps an article's own
blocks whole: articles share runs that are no boilerplate (figures in the README).

Suffixes need to be sorted only to depth ``RUN``: two of them share that many tokens if and only if their first ``RUN`` tokens
are equal.  So suffixes are grouped by host and first ``RUN`` tokens, which finds the
same runs as neighbours in the sorted array and lets a common run be
pre-aggregated, where a sort would put all its copies into one task.  A stream shorter than
``RUN`` is one suffix.  The page's blocks travel compressed in the one
shuffle that brings its repeated places back.

Defined results: null or empty html gives an empty text; a null url is a host of its own (pages without a
url share it); equal rows are one page, so their common tokens alone are no boilerplate; a page that ends inside a tag loses that
tag; an empty table gives no rows; extra columns are kept unless named like the results.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import any_names, row_hash, unused

RUN = 8  # tokens
# Of an Arrow batch that a task gives back: rows of suffixes, and bytes (or characters) of packed pages or texts.
SUFFIXES, SIZE = 32_768, 8 << 20

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CHROME = {"nav", "footer", "aside", "menu", "dialog", "button", "select", "head"}
FORMS = {"form", "fieldset"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
         "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup",
         "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody",
         "td", "tfoot", "th", "thead", "tr", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: an open element of the key is ended by a start tag of the values
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "tbody", "tfoot"},
            "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
            "p": BLOCK, "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"}}
LIMITS = {"table", "ul", "ol", "dl", "select", "div", "article", "section", "main", "nav", "aside", "footer", "header", "form", "body"}
#: a whole class, id or role that marks what is not the article: its parts (between - and _) are words for its place, ...
PLACES = set("site page main global primary secondary top bottom header".split())
#: ... then one of these names (or a word that begins with advert), ...
NAMES = set("ad ads adsense sponsor sponsors sponsored promo promos promotion promotions banner banners navigation nav navbar menu menus menubar "
            "breadcrumb breadcrumbs sidebar complementary footer masthead contentinfo cookie cookies consent gdpr notice notices alert alerts alertdialog "
            "popup modal dialog overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager comment "
            "comments commentlist disqus replies reply search skip".split())
#: ... then such names and words for their shape (right-sidebar, no-comments and search-results are not made like this)
SHAPES = set("container wrapper wrap box bar list lists link links button buttons btn btns icon icons form block area section slot unit units item items "
             "posts articles stories message media to content".split())
PARTS = re.compile(r"[_-]+")
ARTICLE, OTHER, DROPPED = 0, 1, 2
TELLING = re.compile(r"class|id|role|hidden|style", re.I)


def _named(word: str) -> bool:
    """Whether a class, id or role marks its element; each part is looked up once."""
    parts = PARTS.split(word.lower())
    at = 0
    while at < len(parts) - 1 and parts[at] in PLACES:
        at += 1

    def name(p):
        return p in NAMES or p.startswith("advert")

    return name(parts[at]) and all(name(p) or p in SHAPES or p.isdecimal() for p in parts[at + 1:])


def _marked(attrs: str) -> tuple[bool, bool]:
    """Whether the attributes hide the element, and whether they mark it."""
    hides = marks = False
    if TELLING.search(attrs):
        for name, a, b, c, hidden in ATTR.findall(attrs):
            name, value = name.lower(), a or b or c
            if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                hides = True
            elif name in ("class", "id", "role") and any(map(_named, value.split())):
                marks = True
    return hides, marks


class Elements:
    """The elements of a page in order of their start tags, and what becomes of their blocks."""

    def __init__(self):
        self.name, self.parent, self.hard, self.soft, self.holds = [], [], [], [], []

    def add(self, name: str, parent: int, attrs: str) -> int:
        hides, marks = _marked(attrs)
        i, root = len(self.name), name in ("html", "body")
        self.name.append(name)
        self.parent.append(parent)
        self.hard.append(not root and (hides or name in CHROME))
        self.soft.append(not root and (marks or name in FORMS))
        self.holds.append(False)
        if name in ("article", "main"):
            while i >= 0 and not self.holds[i]:
                self.holds[i] = True
                i = self.parent[i]
        return len(self.name) - 1

    def judged(self) -> tuple[list[int], list[int], list[int]]:
        """Each element's kind, its next undecided mark (-1: none), and for each of those the next around it.

        No mark and no form drops an element that is or holds an article or main.  Elements that are chrome by
        their name, or hidden, do unless all articles of the page stand in such.  Without an
        article or main, marks are left to ``main_text``."""
        n = len(self.name)
        some, inside, chrome = any(self.holds), [False] * (n + 1), [False] * (n + 1)  # at -1: none
        spare = True
        for i, (name, p) in enumerate(zip(self.name, self.parent)):
            if name == "header" and not inside[p]:
                self.hard[i] = True
            inside[i] = inside[p] or name == "article"
            chrome[i] = chrome[p] or self.hard[i]
            spare = spare and not (name in ("article", "main") and not chrome[i])
        kind, mark, around = [OTHER] * (n + 1), [-1] * (n + 1), []
        for i, (name, p) in enumerate(zip(self.name, self.parent)):
            drop = self.hard[i] and not (spare and self.holds[i]) or some and self.soft[i] and not self.holds[i]
            kind[i] = DROPPED if drop or kind[p] == DROPPED else ARTICLE if name == "article" or kind[p] == ARTICLE else OTHER
            mark[i] = mark[p]
            if self.soft[i] and not some and kind[i] != DROPPED:
                mark[i] = len(around)
                around.append(mark[p])
        return kind, mark, around


class Open:
    """The open elements.  Counts say at once whether a tag ends one, so only elements that it ends are walked over."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []  # name, number
        self.blocks: Counter = Counter()
        self.inline = [Counter()]  # names of the others, since the last open block
        self.ended = [Counter()]   # names that a start tag can end, since the last limit

    def number(self) -> int:
        return self.stack[-1][1] if self.stack else -1

    def push(self, name: str, number: int) -> None:
        self.stack.append((name, number))
        if name in ENDED_BY:
            self.ended[-1][name] += 1
        if name in LIMITS:
            self.ended.append(Counter())
        if name in BLOCK:
            self.blocks[name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1

    def pop(self) -> str:
        name, _ = self.stack.pop()
        if name in BLOCK:
            self.inline.pop()
            self.blocks[name] -= 1
        else:
            self.inline[-1][name] -= 1
        if name in LIMITS:
            self.ended.pop()
        if name in ENDED_BY:
            self.ended[-1][name] -= 1
        return name

    def end(self, name: str) -> None:
        """An end tag: ends the last such element and those in it; an inline one does not end a block."""
        if (self.blocks if name in BLOCK else self.inline[-1])[name]:
            while self.pop() != name:
                pass

    def make_way(self, name: str) -> None:
        """A block's start tag: ends the last element before a limit that can't hold it."""
        if any(n and name in ENDED_BY[x] for x, n in self.ended[-1].items()):
            while name not in ENDED_BY.get(self.pop(), ()):
                pass


def blocks(page: str | None, articles: bool = True) -> tuple[list[tuple[int, str, int]], list[int]]:
    """The page's blocks in order: kind (of the article, other, or dropped by markup), text, and the next undecided
    mark around it (-1: none); and for each such mark the next one around that.

    Without ``articles``, blocks of an article are left out."""
    page, raw, parts = page or "", [], []
    elements = Elements()
    stack = Open()

    def end_block():
        if parts:
            raw.append(("".join(parts), stack.number()))
            parts.clear()

    at = 0
    while (m := TAG.search(page, at)) is not None:
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        close, name, attrs, close2, name2, attrs2 = m.groups()
        name = (name or name2 or "").lower()
        if not name:
            continue
        if close or close2:
            if name in BLOCK:
                end_block()
            stack.end(name)
            continue
        attrs = attrs or attrs2 or ""
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = len(page) if stop is None and name != "title" else at if stop is None else stop.end()
            continue
        if name in BLOCK:
            end_block()
            stack.make_way(name)
        elif name == "br":
            parts.append(" ")
        if name in VOID or attrs.endswith("/") and name not in BLOCK:
            continue
        stack.push(name, elements.add(name, stack.number(), attrs))
    parts.append(page[at:])
    end_block()
    kind, mark, around = elements.judged()
    out = []
    for text, e in raw:
        if articles or kind[e] != ARTICLE:
            text = " ".join(html.unescape(text).split())
            if text:
                out.append((kind[e], text, mark[e]))
    return out, around


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def suffixes(tokens: list[str], run: int, own: bytes = b"") -> np.ndarray:
    """128 bits (two columns) for the first ``run`` tokens, and ``own``, of every suffix that has so many (one, of all, if none has)."""
    h = b"".join([xxhash.xxh3_128_digest(t.encode()) for t in tokens])
    n = max(1, len(tokens) - run + 1) if tokens else 0
    keys = b"".join([xxhash.xxh3_128_digest(own + h[16 * i:16 * (i + run)]) for i in range(n)])
    return np.frombuffer(keys, np.int64).reshape(n, 2)


def _parsed(page, url, run, articles=True):
    """What ``blocks`` gives, and the suffix keys of the stream outside articles."""
    found = blocks(page, articles)
    return found, suffixes([x for k, t, _ in found[0] if k != ARTICLE for x in t.split(" ")], run, host(url).encode() + b"\0")


def main_text(found: list[tuple[int, str, int]], around: list[int], repeated: set[int], run: int) -> str:
    """The text that is left: tokens covered by repeated runs go, and what markup drops; an article is kept whole.

    A mark that no article or main has decided drops what it holds unless that is most of what is left."""
    outside = [t.split(" ") if k != ARTICLE else [] for k, t, _ in found]
    covered = np.zeros(sum(map(len, outside)), bool)
    for p in repeated:
        covered[p:p + run] = True
    left, at, size, total = [], 0, [0] * len(around), 0
    for (kind, text, mark), tokens in zip(found, outside):
        rest = tokens if kind != ARTICLE else [text]
        if kind == OTHER:
            rest = [t for i, t in enumerate(tokens) if not covered[at + i]]
            total += len(rest)
            if mark >= 0:
                size[mark] += len(rest)
        at += len(tokens)
        if rest and kind != DROPPED:
            left.append((" ".join(rest), mark))
    for i in range(len(around) - 1, -1, -1):  # what a mark holds, with the marks inside it
        if around[i] >= 0:
            size[around[i]] += size[i]
    drops = [2 * n <= total for n in size]
    for i, p in enumerate(around):
        drops[i] = drops[i] or p >= 0 and drops[p]
    return "\n".join(t for t, mark in left if mark < 0 or not drops[mark])


def _suffix_rows(run: int):
    def rows(batch, parts):
        """``parts``: the page's row, the first place, keys."""
        of = pa.array(np.repeat([i for i, _, _ in parts], [len(k) for _, _, k in parts]))
        key = np.concatenate([k for _, _, k in parts])
        place = np.concatenate([np.arange(p, p + len(k), dtype=np.int32) for _, p, k in parts])
        return pa.RecordBatch.from_arrays([
            batch.column("x").take(of), batch.column("y").take(of), pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()),
            pa.array(place)], names=["x", "y", "key", "key2", "place"])

    def go(batches):
        for batch in batches:
            parts, n = [], 0
            for i, (page, url) in enumerate(zip(batch.column("html"), batch.column("url"))):
                keys = _parsed(page.as_py(), url.as_py(), run, articles=False)[1]
                for p in range(0, len(keys), SUFFIXES):
                    parts.append((i, p, keys[p:p + SUFFIXES]))
                    n += len(parts[-1][2])
                    if n >= SUFFIXES:
                        yield rows(batch, parts)
                        parts, n = [], 0
            if parts:
                yield rows(batch, parts)
    return go


def _pieces(batch, values):
    """Slices of the batch with the values of their rows, made one by one: up to ``SIZE`` and a row's."""
    at, held, n = 0, [], 0
    for v in values:
        held.append(v)
        n += len(v)
        if n >= SIZE:
            yield batch.slice(at, len(held)), held
            at, held, n = at + len(held), [], 0
    if held:
        yield batch.slice(at, len(held)), held


def _pack(names: list[str], run: int, page: str, url: str, packed: str):
    def go(batches):
        for batch in batches:
            data = (zlib.compress(json.dumps(_parsed(p.as_py(), u.as_py(), run)[0], ensure_ascii=False).encode(), 6)
                    for p, u in zip(batch.column(names.index(page)), batch.column(names.index(url))))
            for part, packs in _pieces(batch, data):
                old = {k: part.column(i) for i, k in enumerate(names) if k != page}
                yield pa.RecordBatch.from_arrays([*old.values(), pa.array(packs, pa.binary())], names=[*old, packed])
    return go


def _unpack(names: list[str], out: list[str], packed: str, places: str, run: int):
    def go(batches):
        for batch in batches:
            found = (main_text(*json.loads(zlib.decompress(data.as_py())), set(p.as_py() or ()), run)
                     for data, p in zip(batch.column(names.index(packed)), batch.column(names.index(places))))
            for part, texts in _pieces(batch, found):
                old = {k: part.column(i) for i, k in enumerate(names)}
                new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
                yield pa.RecordBatch.from_arrays([(old | new)[k] for k in out], names=out)
    return go


@any_names
def extract(pages: DataFrame, page: str = "html", url: str = "url", run: int = RUN, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep``) without the html, with ``text`` and ``n_chars``."""
    taken = {"text", "n_chars", page.lower()}
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in taken]
    x, y, packed, places, u, on, on2 = unused(pages, "x", "y", "packed", "places", "url", "on", "on2")
    hx, hy = row_hash(pages.select(page, *[c for c in pages.columns if c != page]))
    src = pages.select(*keep, F.col(url).cast("string").alias(u), F.col(page).cast("string").alias(page),
                       hx.alias(x), hy.alias(y))
    rows = src.select(F.col(x).alias("x"), F.col(y).alias("y"), F.col(u).alias("url"), F.col(page).alias("html")) \
        .mapInArrow(_suffix_rows(run), "x bigint, y bigint, key bigint, key2 bigint, place int")
    one = F.struct("x", "y")
    repeated = rows.groupBy("key", "key2").agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select("key", "key2")
    found = rows.join(repeated, ["key", "key2"]).groupBy(F.col("x").alias(on), F.col("y").alias(on2)).agg(F.collect_set("place").alias(places))
    fields = [f for f in src.schema.fields if f.name != page]
    parsed = src.mapInArrow(_pack(src.columns, run, page, u, packed), T.StructType([*fields, T.StructField(packed, T.BinaryType())]))
    joined = parsed.join(found, (parsed[x] == found[on]) & (parsed[y] == found[on2]), "left").select(*keep, packed, places)
    out = [*keep, "text", "n_chars"]
    result = [*[f for f in joined.schema.fields if f.name in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return joined.mapInArrow(_unpack(joined.columns, out, packed, places, run), T.StructType(result))
