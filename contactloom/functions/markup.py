"""Reading simple markup by patterns: for wanted tags of well-formed heads and footers, without walking the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def decoded(c: Column) -> Column:
    """The common character references written out, the ampersand last."""
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def tag_text(html: Column, tag: str) -> Column:
    """The text of the first element of a tag, inner tags as spaces; null if there is none."""
    inner = F.regexp_extract(html, rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)(?:</{tag}\s*>|$)", 1)
    return F.nullif(decoded(F.regexp_replace(inner, r"(?s)<[^>]*>", " ")), F.lit(""))


def meta_content(html: Column, key: str, value: str) -> Column:
    """The content of the first meta tag whose attribute ``key`` comes first and has this value."""
    return F.nullif(decoded(F.regexp_extract(html, rf"""(?is)<meta\s+{key}="{value}"\s+content="([^"]*)\"""", 1)), F.lit(""))


def hrefs(html: Column) -> Column:
    """The href of every anchor, in page order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href="([^"]*)\""""), F.lit(1)), decoded)


def without_code(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "")
