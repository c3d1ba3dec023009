"""One walk over a page's elements: html in, a struct of raw candidates out.

This is the only place where a page is parsed. Everything that decides over the
candidates is a Column expression (``operators.extract``).
"""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link meta nextid param source spacer track wbr".split())
DASHES = str.maketrans(dict.fromkeys("‑–—−‒―‐", "-"))
_ADDRESS = "street STRING, city STRING, region STRING, code STRING, whole STRING"
CANDIDATES = (
    "site_name STRING, org_name STRING, og_title STRING, title STRING, footer STRING, h1 STRING,"
    " links ARRAY<STRING>, link_texts ARRAY<STRING>, phone_texts ARRAY<STRING>, email_texts ARRAY<STRING>,"
    f" addresses ARRAY<STRUCT<{_ADDRESS}>>, address_texts ARRAY<STRING>,"
    " og_description STRING, description STRING, twitter_description STRING, canonical STRING, protected ARRAY<STRING>,"
    " tel_texts ARRAY<STRING>, wide_texts ARRAY<STRING>, mail_texts ARRAY<STRING>, place_texts ARRAY<STRING>"
)


class Element:
    __slots__ = ("tag", "attrs", "parent", "kids", "number")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, number: int):
        self.tag, self.attrs, self.parent, self.kids, self.number = tag, attrs, parent, [], number


class Tree(HTMLParser):
    """Elements in document order; an end tag closes up to the last open element of its name, or nothing."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None, -1)
        self.all: list[Element] = []
        self.here = self.root
        self.open: dict[str, int] = {}
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        kept: dict[str, str] = {}
        for k, v in attrs:
            kept[k] = v or ""
        e = Element(tag, kept, self.here, len(self.all))
        self.here.kids.append(e)
        self.all.append(e)
        if tag not in VOID:
            self.here = e
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open.get(tag):
            while True:
                e = self.here
                self.open[e.tag] -= 1
                self.here = e.parent
                if e.tag == tag:
                    break

    def handle_data(self, data):
        self.here.kids.append(data)


def text_of(e: Element | None, but: list[Element] = ()) -> str | None:
    """Texts below an element, stripped and joined by spaces, without scripts and styles; NFKC, plain hyphens, white space collapsed."""
    if e is None:
        return None
    pieces: list[str] = []
    stack = [e]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            if s := x.strip():
                pieces.append(s)
        elif x is e or x.tag not in ("script", "style", "template") and x not in but:
            stack.extend(reversed(x.kids))
    text = unicodedata.normalize("NFKC", " ".join(pieces)).translate(DASHES)
    return " ".join(text.split()) or None


def below(e: Element, tree: Tree) -> list[Element]:
    out, stack = [], [k for k in reversed(e.kids) if not isinstance(k, str)]
    while stack:
        x = stack.pop()
        out.append(x)
        stack.extend(k for k in reversed(x.kids) if not isinstance(k, str))
    return out


def candidates(page: str | None, extended: bool = False) -> tuple:
    """Values of CANDIDATES for a page; the last four lists only for the extended profile."""
    tree = Tree(page or "")
    all_ = tree.all
    first = lambda fits, among=all_: next((e for e in among if fits(e)), None)
    meta = lambda key, value: (m.attrs.get("content") or None) if (m := first(lambda e: e.tag == "meta" and e.attrs.get(key) == value)) else None
    prop = lambda e, name: text_of(first(lambda x: x.attrs.get("itemprop") == name, below(e, tree)))
    org = first(lambda e: "Organization" in e.attrs.get("itemtype", ""))
    anchors = [e for e in all_ if e.tag == "a" and "href" in e.attrs]
    texts: dict[int, str | None] = {}

    def text(e: Element) -> str | None:
        if e.number not in texts:
            texts[e.number] = text_of(e)
        return texts[e.number]

    named = lambda e, *parts: any(p in e.attrs.get("class", "") for p in parts)
    plain = [e for e in all_ if e.tag in ("p", "div", "span", "address", "footer")]
    calls = [e for e in all_ if e.tag in ("p", "div", "span", "address", "footer") or named(e, "contact", "phone", "tel")]
    places = [e for e in all_ if e.tag in ("address", "footer") or {"address", "location"} & set(e.attrs.get("class", "").split()) or named(e, "addr")]
    listed = lambda es, fits=lambda t: True: list(dict.fromkeys(t for e in es if (t := text(e)) and fits(t)))
    digits = lambda t: any(c.isdigit() for c in t)
    wide: tuple = ([], [], [], [])
    if extended:
        blocks = [e for e in all_ if "PostalAddress" in e.attrs.get("itemtype", "")]
        either = lambda e, *parts: any(p in e.attrs.get(k, "") for p in parts for k in ("class", "id"))
        spots = [e for e in all_ if e not in blocks and (e in places or "addr" in e.attrs.get("id", "") or {"contact-info", "contact-details", "widget_contact_info"} & set(e.attrs.get("class", "").split()) or e.tag == "div" and e.attrs.get("itemtype") == "http://schema.org/Organization")]
        wide = (
            listed([e for e in anchors if e.attrs["href"].startswith("tel:")]),
            listed([e for e in all_ if e.tag in ("p", "div", "span", "li", "td", "address", "footer", "header") or e.attrs.get("itemprop") == "telephone" or either(e, "contact", "phone", "tel")], digits),
            listed([e for e in all_ if e.tag in ("p", "div", "span", "li", "td", "address", "footer", "article", "section", "a", "font")]),
            list(dict.fromkeys(t for e in spots if (t := text_of(e, blocks)))),
        )
    link = first(lambda e: e.tag == "link" and "canonical" in e.attrs.get("rel", "").split())
    return (
        meta("property", "og:site_name"), prop(org, "name") if org else None, meta("property", "og:title"), text_of(first(lambda e: e.tag == "title")), text_of(first(lambda e: e.tag == "footer")), text_of(first(lambda e: e.tag == "h1")),
        [e.attrs["href"] for e in anchors], listed(anchors, digits), listed(calls, digits), listed(plain),
        [(prop(e, "streetAddress"), prop(e, "addressLocality"), prop(e, "addressRegion"), prop(e, "postalCode"), text_of(e)) for e in all_ if "PostalAddress" in e.attrs.get("itemtype", "")], listed(places),
        meta("property", "og:description"), meta("name", "description"), meta("name", "twitter:description"), (link.attrs.get("href") or None) if link else None,
        [e.attrs["data-cfemail"] for e in all_ if "__cf_email__" in e.attrs.get("class", "").split() and e.attrs.get("data-cfemail")],
        *wide,
    )


def raw_candidates(html: Column, extended: bool = False) -> Column:
    """A struct of CANDIDATES for each page, made in Arrow batches.

    It counts as not deterministic, so that no filter over what is made of it is moved before it: that would walk each page twice.
    """
    address = pa.struct([(x.split()[0], pa.string()) for x in _ADDRESS.split(", ")])
    kinds = {"STRING": pa.string(), "ARRAY<STRING>": pa.list_(pa.string())}
    fields = [pa.field(name, kinds.get(kind, pa.list_(address))) for name, kind in (x.split(maxsplit=1) for x in _split_top(CANDIDATES))]

    def run(pages: pa.Array) -> pa.Array:
        columns = dict(zip((f.name for f in fields), zip(*(candidates(p, extended) for p in pages.to_pylist()))))
        columns["addresses"] = [[dict(zip(address.names, a)) for a in r] for r in columns.get("addresses", ())]
        return pa.StructArray.from_arrays([pa.array(columns.get(f.name, ()), f.type) for f in fields], fields=fields)

    return F.arrow_udf(run, CANDIDATES).asNondeterministic()(html)


def _split_top(ddl: str) -> list[str]:
    """Fields of a DDL list, by the commas outside brackets."""
    out, depth, field = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(field.strip())
            field = ""
        else:
            field += c
    return [*out, field.strip()]
