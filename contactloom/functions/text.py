"""Text functions: Column in, Column out, all of them compiled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.lexicons import GENERIC_NAMES

EMAIL = r"[a-zA-Z0-9!#$%&'*+/=?^_`{|}~.-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
#: hyphens and dashes that count as a hyphen
DASHES = "‑–—−‒―‐"
#: what separates the parts of a title
SEPARATOR = r"\s*[\|\-–—]\s*"
COPYRIGHT = r"(?i)©\s*(?:\d{4}[-\s]?\d{4}|\d{4})?\s*([^.,\n]+?)(?:\s*(?:All Rights Reserved|Inc\.?|LLC|Ltd\.?|Corp\.?))?(?:\.|$)"

#: nothing but a copyright notice whose holder, without punctuation, has one number in its name
NUMBERED_NOTICE = r"(?iU)^(?:copyright\s*)?©\s*(?:\d{4}(?:[-\s]+\d{4})?\b)?[^\d.,\n]*\d+[^\d.,\n]*\.?\s*(?:All Rights Reserved\.?)?$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clean_text(c: Column) -> Column:
    """White space (Unicode) collapsed and stripped; null if nothing is left."""
    one = F.regexp_replace(c, r"(?U)\s+", " ")
    return F.nullif(F.regexp_replace(one, "^ | $", ""), F.lit(""))


def plain_hyphens(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def space_before_punctuation(c: Column) -> Column:
    """No white space before a full stop, comma and the like."""
    return F.regexp_replace(c, r"\s+([.,;:!?])", "$1")


def normalize_email(c: Column) -> Column:
    """Lower case, stripped; null unless the whole is an address."""
    return let(F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", ""), lambda e: F.when(F.regexp_like(e, F.lit(f"^(?:{EMAIL})$")), e))


def emails_in(c: Column) -> Column:
    """Distinct addresses in a text, lower case, sorted; none for null."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def deobfuscate(c: Column) -> Column:
    """``[at]``, ``(at)``, `` at `` and their dots written out."""
    for sign, word in (("@", "at"), (".", "dot")):
        for pattern in (rf"(?iU)\s*\[{word}\]\s*", rf"(?iU)\s*\({word}\)\s*", rf"(?iU)\s+{word}\s+"):
            c = F.regexp_replace(c, pattern, sign)
    return c


# fixed values: ways to hide the signs of an address (extended profile)
EXTENDED_SIGNS = (
    (r"(?i)\s*\[\s*(?:at|@)\s*\]\s*", "@"),
    (r"(?i)\s*\(\s*(?:at|@)\s*\)\s*", "@"),
    (r"(?i)\s+(?:at)\s+", "@"),
    (r"\bAT\b", "@"),
    (r"(?i)\s*<at>\s*", "@"),
    ("\uff20", "@"),
    ("\ufe6b", "@"),
    (r"(?i)&commat;", "@"),
    (r"(?i)\s*\[\s*(?:dot|\.)\s*\]\s*", "."),
    (r"(?i)\s*\(\s*(?:dot|\.)\s*\)\s*", "."),
    (r"(?i)\s+(?:dot)\s+", "."),
    (r"\bDOT\b", "."),
    (r"(?i)\s*<dot>\s*", "."),
    ("\u2024", "."),
    ("\uff0e", "."),
    (r"(?i)&period;", "."),
    (r"\s+en\s+", "@"),
    (r"(?i)\s+dt\s+", "."),
    (r"\s*@\s*", "@"),
    (r"\s*\.\s*", "."),
)


def deobfuscate_extended(c: Column) -> Column:
    """The signs written out, and white space around them taken away."""
    for pattern, sign in EXTENDED_SIGNS:
        c = F.regexp_replace(c, pattern, sign)
    return c


def is_generic_name(c: Column) -> Column:
    return F.lower(c).isin(*GENERIC_NAMES)


def specific(c: Column) -> Column:
    """The name, or null if it is empty or a generic term."""
    return let(c, lambda x: F.when((x != "") & ~is_generic_name(x), x))


def title_parts(c: Column) -> Column:
    return F.split(c, SEPARATOR)


def company_in_title(c: Column) -> Column:
    """The last part of a title that has several; null if it or the whole is generic."""

    def last(title: Column) -> Column:
        return let(title_parts(title), lambda parts: F.when((F.size(parts) > 1) & (title != "") & ~is_generic_name(title), specific(clean_text(F.try_element_at(parts, F.lit(-1))))))

    return let(c, last)


def undivided_title(c: Column) -> Column:
    return let(c, lambda title: F.when(F.size(title_parts(title)) == 1, specific(title)))


def copyright_holder(c: Column) -> Column:
    return specific(clean_text(F.nullif(F.regexp_extract(c, COPYRIGHT, 1), F.lit(""))))


def numbered_notice(c: Column) -> Column:
    """Whether a text is only a copyright notice of a holder with a number in its name; the year and that number are no address."""
    return F.coalesce(F.regexp_like(c, F.lit(NUMBERED_NOTICE)), F.lit(False))


def joined(c: Column, separator: str) -> Column:
    """A list as text; null as the empty text."""
    return F.concat_ws(separator, c)


def has(c: Column) -> Column:
    """Whether a list or map has entries; null has none."""
    return F.coalesce(F.size(c), F.lit(0)) > 0


def filled(c: Column) -> Column:
    """Whether a text is neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def captcha(html: Column) -> Column:
    """Whether a page's first 2,500 characters speak of a robot check."""
    head = F.lower(clean_text(F.substring(html, 1, 2500)))
    return F.coalesce(F.regexp_like(head, F.lit("captcha|are you a robot|verify you.re human|turnstile")), F.lit(False))


def markdown(html: Column) -> Column:
    """A page as plain lines with headings, list marks and links; scripts and styles left out."""
    c = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    for level in range(1, 7):
        c = F.regexp_replace(c, rf"(?i)<h{level}\b[^>]*>", "\n\n" + "#" * level + " ")
    c = F.regexp_replace(c, r"(?is)<li\b[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>""", "[$2]($1)")
    c = F.regexp_replace(c, r"(?is)<br\s*/?>|</(p|div|tr|ul|ol|h[1-6]|article|section|footer|header|nav)\s*>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", ""), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"\n\s*\n\s*", "\n\n"), r"(?U)^\s+|\s+$", "")


# fixed values
PAGE_LIMIT, CUT_MARK = 98_304, "\n\n[Content truncated]"


def shortened(c: Column, limit: int = PAGE_LIMIT) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(CUT_MARK))).otherwise(c)


def prompt(template: str, *columns: Column) -> Column:
    """A prompt with ``%s`` for each column."""
    return F.format_string(template, *columns)
