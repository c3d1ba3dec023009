"""Main text of web pages, by wrappers inferred per host.

A page is a stream of text tokens, each with the path of tags and classes it
stands under. The stream is folded into a union-free regular expression: equal
neighbours, and groups of up to FOLD tokens that follow one another in the same
order, become repetitions. Expressions of a host are aligned one after another,
in order: where texts differ, a text becomes a slot; where tokens differ, the
stream that meets the other one sooner again has an optional group before that.
What stays a constant text, or a repetition of the same texts, on every page
that has it is the host's template and goes from all of its pages, inside
articles too. Expressions are merged within a map task first, then over salted
parts of a host, then per host, so no task gathers the pages of a host, only
expressions of template size.

The rest of the main text is what stands in articles or main elements (on a
page without them, in the body), but for regions that hold menus, headers,
footers, sidebars, notices, adverts, forms or comments by their tag, role or
class.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.llm.common import by_bytes, stored, texts_of
from contactloom.llm.url_reputation import host_of

#: A text is template if it is the same on so many pages of the host at least, and on all that have its slot; inside an article
#: it takes more of them, since a few pages may well be copies of one another.
LEAST_PAGES, LEAST_INSIDE = 3, 20
SALTS = 32
#: Tokens of a group that is looked for as a repetition, at most.
FOLD = 4
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)(\s*/?>)?", re.S)
_NAME, _BARE, _GAP, _EQUALS = re.compile(r"[^\s>/=][^\s>/=]*"), re.compile(r"[^\s>]*"), re.compile(r"[\s/=]*"), re.compile(r"\s*=\s*")
_PART = re.compile(r"[A-Za-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr script style math mi mn mo mrow mtext msup msub mfrac msqrt".split())
#: closed by the start of another of their kind, up to a container
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
BARRIER = frozenset("html body div section article main table ul ol dl blockquote td th nav aside header footer form".split())
SKIP_TAGS = frozenset("nav aside footer form button select dialog menu head".split())
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adslot sponsor sponsored sponsors promo promos promotion promoted banner menu menus nav navbar navigation breadcrumb breadcrumbs"
    " sidebar sidebars widget widgets footer masthead comment comments commentlist discussion disqus reply replies respond notice notices cookie cookies consent gdpr newsletter subscribe subscription"
    " signup popup modal overlay share sharing social related recommended recommendations toolbar pagination pager login search skip".split()
)
#: Inside an article only these count, and only as a whole class or id, or with words for a box.
SKIP_INSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertisements adslot sponsored promo promos menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments commentlist discussion disqus"
    " reply replies respond cookie cookies consent newsletter subscribe signup popup modal overlay share sharing social related recommended pagination pager toolbar".split()
)
BOXES = frozenset("area articles bar block bottom box buttons container content form group inner items left link links list main page panel posts right section top unit wrap wrapper".split())
NEVER = frozenset("html body main".split())


def skipped(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element holds no main text. ``inside``: it stands in an article or main element."""
    if tag in NEVER:
        return False
    if tag in SKIP_TAGS or tag == "header" and not inside:
        return True
    if attrs.get("role", "").lower() in SKIP_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower()
    if inside:
        return any((parts := set(_PART.findall(x))) & SKIP_INSIDE and parts <= SKIP_INSIDE | BOXES for x in names.split())
    named = set(_PART.findall(names))
    return bool(named & SKIP_WORDS) or "header" in named and tag not in ("h1", "h2", "h3")


class Scanner:
    """Reads a page's tags. Every character is looked at a bounded number of times, whatever quotes stay open."""

    def __init__(self, page: str):
        self.page = page
        self.closed = {'"': True, "'": True}  # whether one may still follow
        self.last_close: dict[str, int] = {}

    def attributes(self, at: int) -> tuple[dict[str, str], int]:
        """The attributes that begin at ``at``, and where their tag ends."""
        page, found = self.page, {}
        while True:
            at = _GAP.match(page, at).end()
            if at >= len(page):
                return found, at
            if page[at] == ">":
                return found, at + 1
            m = _NAME.match(page, at)
            at, value = m.end(), ""
            if e := _EQUALS.match(page, at):
                at = e.end()
                quote = page[at : at + 1]
                end = page.find(quote, at + 1) if self.closed.get(quote) else -1
                if end >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    if quote in self.closed:
                        self.closed[quote] = False
                    v = _BARE.match(page, at)
                    value, at = v.group(), v.end()
            found.setdefault(m.group().lower(), value)

    def closes_later(self, tag: str, at: int) -> bool:
        if tag not in self.last_close:
            self.last_close[tag] = max((m.start() for m in re.finditer(rf"</{tag}[\s>]", self.page, re.I)), default=-1)
        return self.last_close[tag] >= at


class Block:
    """A run of text without a block boundary: its path's hash, its text, the article it stands in, whether it is skipped."""

    __slots__ = ("path", "text", "region", "skip")

    def __init__(self, path: int, text: str, region: int, skip: bool):
        self.path, self.text, self.region, self.skip = path, text, region, skip


def blocks(page: str) -> list[Block]:
    """Blocks with text, in page order. A region is 0 outside of article and main elements."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, int]] = []  # tag, path, skip, region
    opened: dict[str, int] = {}
    pieces: list[str] = []
    scanner = Scanner(page)
    n_regions = 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                _, path, skip, region = stack[-1] if stack else ("", 0, False, 0)
                out.append(Block(path, text, region, skip))

    def pop(i: int) -> None:
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _MARK.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw:
            pieces.append(html.unescape(raw) if "&" in raw else raw)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attrs = m[2].lower(), {}
        if not m[3]:
            attrs, at = scanner.attributes(at)
        inline = tag in INLINE
        if not inline:
            flush()
        if m[1]:
            if opened.get(tag):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        if inline and stack[i][2] and not (stack[i - 1][2] if i else False):
                            flush()
                        pop(i)
                        break
                    if inline and stack[i][0] not in INLINE or tag not in BARRIER and stack[i][0] in BARRIER:
                        break
            continue
        if tag in RAW:
            if not page.endswith("/>", m.start(), at):
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        closes = CLOSES.get(tag, frozenset()) | ({"p"} if tag in BLOCKS_P else frozenset())
        if any(opened.get(x) for x in closes):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop(i)
                    break
                if stack[i][0] in BARRIER:
                    break
        role = attrs.get("role", "").lower()
        if tag in ("article", "main"):
            # an unclosed menu or header before it does not swallow it
            while stack and stack[-1][2] and stack[-1][0] in SKIP_TAGS | {"header"} and not scanner.closes_later(stack[-1][0], at):
                pop(len(stack) - 1)
        _, path, parent_skip, region = stack[-1] if stack else ("", 0, False, 0)
        skip = parent_skip or skipped(tag, attrs, region > 0)
        if not skip and not region and (tag in ("article", "main") or role in ("main", "article")):
            n_regions += 1
            region = n_regions
        if inline and skip and not parent_skip:
            flush()
        if not inline or skip != parent_skip:
            # inline marks are no part of a path; numbers in class names count pages, not kinds
            path = xxhash.xxh64_intdigest(tag + "".join("." + _DIGITS.sub("0", c) for c in sorted(set(attrs.get("class", "").split()))), path)
        stack.append((tag, path, skip, region))
        opened[tag] = opened.get(tag, 0) + 1
    flush()
    return out


def main_region(found: list[Block]) -> list[Block]:
    """Blocks that are not skipped: those of all article and main elements, or all if there are none."""
    own = [b for b in found if not b.skip]
    return [b for b in own if b.region] or own


# --- wrappers: lists of [path, hash of the constant text or None for a slot, pages, repeated, optional, inside an article]


def expression(found: list[Block]) -> tuple[list[list], list[list[int]]]:
    """The folded expression of a page, and which blocks each of its items has."""
    items: list[list] = []
    held: list[list[int]] = []

    def join(into: int, other: int) -> None:
        # a repetition of the same texts in the same order is a constant too
        items[into][1] = xxhash.xxh64_intdigest(items[other][1].to_bytes(8, "little"), items[into][1])
        items[into][3] = True
        held[into] += held[other]

    for k, b in enumerate(found):
        items.append([b.path, xxhash.xxh64_intdigest(b.text), 1, False, False, b.region > 0])
        held.append([k])
        for size in range(1, FOLD + 1):
            n = len(items)
            if n >= 2 * size and all(items[n - size + i][0] == items[n - 2 * size + i][0] for i in range(size)):
                for i in range(size):
                    join(n - 2 * size + i, n - size + i)
                del items[n - size :], held[n - size :]
                break
    return items, held


def align(a: list[list], b: list[list]) -> list[list]:
    """One expression for both, in order: what only one side has becomes optional, texts that differ become slots."""
    places: list[dict[int, list[int]]] = []
    for side in (a, b):
        at: dict[int, list[int]] = {}
        for k, x in enumerate(side):
            at.setdefault(x[0], []).append(k)
        places.append(at)

    def ahead(side: int, path: int, after: int) -> int | None:
        at = places[side].get(path, ())
        k = bisect_right(at, after)
        return at[k] if k < len(at) else None

    out: list[list] = []
    alone = lambda items: out.extend([*x[:4], True, x[5]] for x in items)
    i = j = 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        if x[0] == y[0]:
            out.append([x[0], x[1] if x[1] == y[1] else None, x[2] + y[2], x[3] or y[3], x[4] or y[4], x[5] or y[5]])
            i, j = i + 1, j + 1
            continue
        u, v = ahead(0, y[0], i), ahead(1, x[0], j)
        if u is None and v is None:
            alone([x, y])
            i, j = i + 1, j + 1
        elif v is None or u is not None and u - i <= v - j:
            alone(a[i:u])
            i = u
        else:
            alone(b[j:v])
            j = v
    alone(a[i:])
    alone(b[j:])
    return out


def templates(wrapper: list[list], least: int = LEAST_PAGES, least_inside: int = LEAST_INSIDE) -> list[str]:
    """``path:hash`` of every constant of the wrapper."""
    return sorted({f"{x[0]}:{x[1]}" for x in wrapper if x[1] is not None and x[2] >= (least_inside if x[5] else least)})


def text_of(page: str, constant: frozenset = frozenset()) -> str:
    """The main text of a page of a host with these template texts. A page that is nothing but template keeps its text."""
    found = blocks(page)
    region = main_region(found)
    if constant:
        items, held = expression(found)
        gone = {k for x, own in zip(items, held) if f"{x[0]}:{x[1]}" in constant for k in own}
        left = {id(b) for k, b in enumerate(found) if k not in gone}
        region = [b for b in region if id(b) in left] or region
    return " ".join(b.text for b in region)


def _merged(groups: dict[str, list], host: str, wrapper: list) -> None:
    groups[host] = align(groups[host], wrapper) if host in groups else wrapper


def wrappers(pages: DataFrame, salts: int = SALTS) -> DataFrame:
    """``(host, wrapper)`` with the wrapper as JSON, from all ``pages(url, html)``."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[str, list] = {}
        for batch in batches:
            hosts, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, host in enumerate(hosts):
                _merged(groups, host, expression(blocks(texts[i].as_py() or ""))[0])
                if len(groups) >= 2000:
                    yield rows(groups)
                    groups = {}
        if groups:
            yield rows(groups)

    def rows(groups: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(groups)), pa.array([json.dumps(w) for w in groups.values()])], ["host", "wrapper"])

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        groups: dict[str, list] = {}
        for w in sorted(group["wrapper"]):
            _merged(groups, group["host"].iloc[0], json.loads(w))
        return pd.DataFrame({"host": list(groups), "wrapper": [json.dumps(w) for w in groups.values()]})

    slim = pages.select(host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html")).where("html is not null")
    partial = slim.mapInArrow(per_task, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)))
    salted = partial.groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return salted.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def host_templates(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """``(host, constant)``: the template texts of every host that has any, written and reread, so that their size is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [templates(json.loads(w), least) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["host", "constant"])

    return stored(wrappers(pages).mapInArrow(run, "host string, constant array<string>").where("size(constant) > 0"))


def extract(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """Every row of ``pages`` as page_id, url, text and n_chars (code points).

    A null html has an empty text. Pages without a host share the wrapper of
    the empty host; repeated rows count as pages each and come out each; other
    columns are ignored. The templates join the pages by host: they are one row
    a host, sent to every task if small (Spark checks their size), else joined
    by a sort-merge join, in which a hot host's pages can be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, constant = texts_of(batch.column(2)), batch.column(3)
            for part in by_bytes([], [len(t) for t in texts]):
                at = slice(part.start, part.stop)
                found = [text_of(t, frozenset(c.as_py() or ())) for t, c in zip(texts[at], constant[at])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[at], batch.column(1)[at], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    known = host_templates(pages, least).withColumnRenamed("host", "known_host")
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url")).alias("host"))
    joined = slim.join(known, slim.host == known.known_host, "left").select("page_id", "url", "html", "constant")
    return joined.mapInArrow(run, f"page_id {joined.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
