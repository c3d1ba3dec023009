"""URL functions: Column in, Column out."""

from __future__ import annotations

from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.functions.text import let
from contactloom.lexicons import LONG_SUFFIXES, PLACEHOLDER_SITES, PLACEHOLDER_TLDS

IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def is_http(c: Column) -> Column:
    return F.coalesce(F.regexp_like(F.trim(c), F.lit("^https?://")), F.lit(False))


def authority(c: Column) -> Column:
    """What stands between ``scheme://`` and the path, as written: port, case and www are kept; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def scheme(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def host(c: Column) -> Column:
    """The authority without user and port, lower case."""
    return F.lower(F.regexp_replace(authority(c), r"^[^@]*@|:\d*$", ""))


def site(c: Column) -> Column:
    """``scheme://authority``; null without either."""
    return F.concat(scheme(c), F.lit("://"), authority(c))


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(authority(c)).isin(*PLACEHOLDER_SITES), F.lit(False))


def website(c: Column) -> Column:
    """The site of a page's url, null for placeholders."""
    return F.when(~is_placeholder(c), site(c))


def website_extended(canonical: Column, source: Column) -> Column:
    """The site of the canonical url if it has one, else of the source; placeholders and their top-level domains give null."""
    own = lambda c: F.when(~is_placeholder(c) & ~F.coalesce(F.regexp_like(host(c), F.lit("(" + "|".join(t.replace(".", r"\.") for t in PLACEHOLDER_TLDS) + ")$")), F.lit(False)), site(c))
    return F.coalesce(own(canonical), own(source))


def registered_domain(c: Column, with_subdomain: bool = False) -> Column:
    """The domain one label below its public suffix; IP addresses and localhost as they are; null for mail and phone links.

    The suffix is the last label, or one of a list of two-label suffixes.
    """
    whole = F.when(F.regexp_like(c, F.lit("://")), c).otherwise(F.concat(F.lit("http://"), c))

    def named(h: Column) -> Column:
        long = F.substring_index(h, ".", -2).isin(*LONG_SUFFIXES)
        labels = F.size(F.split(h, r"\."))
        below = F.when(long & (labels > 2), F.substring_index(h, ".", -3)).when(~long & (labels > 1) & F.regexp_like(h, F.lit(r"\.[a-z][a-z0-9-]+$")), F.substring_index(h, ".", -2))
        return F.when(F.regexp_like(h, F.lit(IPV4)) | (h == "localhost"), h).otherwise(F.when(below.isNotNull(), h) if with_subdomain else below)

    return F.when(~F.coalesce(F.regexp_like(c, F.lit("(?i)^(mailto|tel):")), F.lit(False)), let(F.regexp_replace(host(whole), r"\.$", ""), named))


def _joined(base: str | None, link: str | None) -> str | None:
    try:
        return urljoin(base or "", link) if link is not None else None
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """RFC resolution of a relative link; the rare forms that ``absolute`` leaves to it."""
    return pd.Series([_joined(b, x) for b, x in zip(base, link)], dtype=object)


def looks_like_domain(link: Column) -> Column:
    first = F.regexp_extract(link, r"^([^/?#]*)", 1)
    return F.startswith(link, F.lit("www.")) | F.contains(first, F.lit("."))


def absolute(base: Column, link: Column, strict: bool = True, general: bool = True) -> Column:
    """A link made absolute.

    Null and blank give null; with a scheme it stays; ``//host`` and ``/path``
    are resolved in place. In the strict profile whatever has a dot before its
    first slash counts as a domain without scheme (``page.html`` too); the
    extended one asks for ``www.`` or a known ending. Other forms go through a
    vectorised resolver, or give null if ``general`` is off.
    """
    x = F.nullif(F.regexp_replace(link, r"(?U)^\s+|\s+$", ""), F.lit(""))

    def in_place(y: Column) -> Column:
        domain = looks_like_domain(y) if strict else F.startswith(y, F.lit("www.")) | F.regexp_like(y, F.lit(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.(com|org|net|edu|gov|io|co|us|uk|de|fr|es)(/|$)"))
        return (
            F.when(F.regexp_like(y, F.lit(SCHEME)), y)
            .when(F.startswith(y, F.lit("//")), F.concat(scheme(base), F.lit(":"), y))
            .when(~F.startswith(y, F.lit("/")) & domain, F.concat(F.lit("http://"), y))
            .when(F.startswith(y, F.lit("/")) & ~F.contains(y, F.lit("/.")), F.concat(site(base), y))
        )

    done = let(x, in_place)
    return F.when(done.isNotNull(), done).when(x.isNotNull(), resolved(base, x)) if general else done


def fetchable(c: Column) -> Column:
    """Whether a fetch would be tried: http(s) and a domain."""
    return F.coalesce(F.regexp_like(c, F.lit("^https?://")), F.lit(False)) & registered_domain(c).isNotNull()


def parsed_ok(url: str) -> bool:
    try:
        parts = urlparse(url)
    except ValueError:
        return False
    return bool(parts.scheme and parts.netloc)
