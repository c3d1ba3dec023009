"""Page extraction: html to a contact record.

``strict`` takes what the pages say at face value in a fixed order of trust;
``extended`` looks further (more markup, more forms, more checks). One Arrow
batch function walks each page once; all the rest are compiled expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import contacts as C
from contactloom.functions import dom, text, urls

STRICT, EXTENDED = "strict", "extended"


def company_name(c: Column, organisation: Callable[[Column], Column] | None = None) -> Column:
    """By trust: site name, organisation, the title's last part (shared, then own), the whole shared title, the footer's owner.

    Last comes what ``organisation`` finds in the first heading, a plug for a model that knows names.
    """
    named = [text.specific(organisation(c["h1"]))] if organisation else []
    return text.let(text.clean_text(c["og_title"]), lambda og_title: F.coalesce(
        text.specific(text.clean_text(c["site_name"])), text.specific(c["org_name"]), text.company_in_title(og_title),
        text.company_in_title(c["title"]), text.undivided_title(og_title), text.copyright_holder(c["footer"]), *named,
    ))


def company_name_extended(c: Column, url: Column) -> Column:
    """The best score among all parts of all candidates, then the shortest, then the first in the alphabet.

    Parts have five words at most, more than two characters, are no number and
    no part of the site's domain.
    """
    domain = F.coalesce(urls.registered_domain(url), F.lit(""))
    split = r"\s*[|\-–—:•]\s*"

    def scored(value: Column, score: int, parts: bool = True) -> Column:
        v = text.clean_text(value)
        pieces = F.split(v, split) if parts else F.array(v)
        return F.transform(F.coalesce(pieces, F.array().cast("array<string>")), lambda p: F.struct(F.lit(-score).alias("s"), F.length(text.clean_text(p)).alias("n"), text.clean_text(p).alias("name")))

    legal = F.nullif(F.regexp_extract(c["footer"], r"(?i)©\s*(?:\d{4}(?:[-\s]\d{4})?)?\s*([^,\n|]+?\b(?:Inc|LLC|Ltd|Corp|GmbH|PLC)\b\.?)", 1), F.lit(""))
    found = F.concat(
        scored(c["site_name"], 10, False), scored(c["org_name"], 9, False), scored(c["og_title"], 8), scored(c["title"], 7),
        scored(legal, 7, False), scored(text.copyright_holder(c["footer"]), 6, False), scored(c["h1"], 5),
    )

    def fine(x: Column) -> Column:
        name = x["name"]
        squeezed = F.lower(F.regexp_replace(name, "[^0-9A-Za-z]", ""))
        return name.isNotNull() & (x["n"] > 2) & (F.size(F.split(name, " ")) <= 5) & ~F.regexp_like(name, F.lit(r"^[\d\s]+$")) & ~text.is_generic_name(name) & ((F.contains(name, F.lit(" "))) | ~F.contains(domain, squeezed) | (x["s"] <= -9))

    return F.get(F.array_sort(F.filter(found, fine)), F.lit(0))["name"]


def phones(c: Column, extended: bool = False) -> Column:
    """Numbers of telephone links, of link texts with digits, and of matches in the text elements.

    The extended profile cleans more off a number, reads a link's text as a
    whole before it scans it, and looks into more elements.
    """
    tel = F.filter(c["links"], lambda h: F.startswith(h, F.lit("tel:")))
    if not extended:
        said = F.flatten(F.transform(c["phone_texts"], C.phone_candidates))
        return C.distinct_sorted(F.transform(F.concat(F.transform(tel, lambda h: F.replace(h, F.lit("tel:"), F.lit(""))), c["link_texts"], said), C.to_e164))
    texts = lambda name: C.first_seen(F.transform(c[name], text.space_before_punctuation))

    def of_link(t: Column) -> Column:
        return text.let(C.parse_phone(C.clean_phone_extended(t)), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(C.scanned_phones(t)))

    said = F.transform(F.filter(texts("wide_texts"), lambda t: F.length(t) >= 7), C.scanned_phones)
    return C.distinct_sorted(F.concat(F.transform(tel, C.linked_phones), F.flatten(F.transform(texts("tel_texts"), of_link)), F.flatten(said)))


def emails(c: Column, extended: bool = False) -> Column:
    """Addresses of mail links, protected links and the text elements."""
    hidden = F.transform(c["links"], C.protected_link)
    linked = F.transform(c["links"], C.mail_link)
    read = text.deobfuscate_extended if extended else text.deobfuscate
    heard = F.filter(F.transform(c["mail_texts"], text.space_before_punctuation), lambda t: F.length(t) >= 5) if extended else c["email_texts"]
    said = F.flatten(F.transform(heard, lambda t: F.filter(text.emails_in(read(t)), lambda e: ~C.is_generic_email(e, extended))))
    all_ = F.concat(hidden, linked, said)
    if extended:
        marked = F.transform(c["protected"], lambda h: text.normalize_email(C.decode_cloudflare(h)))
        fine = lambda e: ~F.regexp_like(e, F.lit(r"\.\.|^\.|\.$|\.@|@[.-]|@localhost")) & (F.length(e) <= 254)
        all_ = F.filter(F.concat(all_, F.filter(marked, lambda e: ~C.is_generic_email(e, True))), fine)
    return C.distinct_sorted(all_)


def addresses(c: Column, extended: bool = False) -> Column:
    """Marked-up addresses, and the address-like texts of the usual elements; a copyright notice that holds only a year and a numbered name is none.

    The extended profile parses each text into parts and writes these in one
    form: those of marked-up blocks first, then of other elements whose text no
    address found holds, or which holds most of one.
    """
    if not extended:
        marked = F.transform(c["addresses"], lambda a: C.postal_address(a["street"], a["city"], a["region"], a["code"]))
        return C.distinct_sorted(F.concat(marked, F.filter(c["address_texts"], lambda t: C.address_shaped(t) & ~text.numbered_notice(t))))
    read = lambda t: C.format_address(C.parse_address(text.space_before_punctuation(t)))

    def of_block(a: Column) -> Column:
        parts = F.concat_ws(", ", a["street"], a["city"], a["region"], a["code"])
        whole = F.when((F.length(a["whole"]) >= 10) & (F.length(a["whole"]) <= 500), read(a["whole"]))
        return F.coalesce(whole, F.when(F.length(parts) > 10, read(parts)))

    def with_others(found: Column) -> Column:
        def new(t: Column) -> Column:
            held = F.exists(found, lambda a: F.contains(F.lower(a), F.lower(t)) | (F.contains(F.lower(t), F.lower(a)) & (F.length(a) > F.length(t) * 0.7)))
            return (F.length(t) > 15) & (F.length(t) < 400) & ~held

        return C.distinct_sorted(F.concat(found, F.transform(F.filter(c["place_texts"], new), read)))

    return text.let(C.first_seen(F.transform(c["addresses"], of_block)), with_others)


def social_links(c: Column, url: Column, extended: bool = False) -> Column:
    """The first profile link of each platform, in page order; a link serves one platform."""
    made = F.transform(F.filter(c["links"], lambda h: h != ""), lambda h: urls.absolute(url, h, strict=not extended, general=False))
    named = F.filter(F.transform(made, lambda u: F.struct(C.social_platform(u, extended).alias("p"), u.alias("u"))), lambda x: x["p"].isNotNull())
    platforms = F.array_sort(F.array_distinct(F.transform(named, lambda x: x["p"])))
    return F.map_from_arrays(platforms, F.transform(platforms, lambda p: F.get(F.filter(named, lambda x: x["p"] == p), F.lit(0))["u"]))


def description(c: Column) -> Column:
    """The first of the three descriptions that has more than ten characters and is no generic term."""
    fine = lambda v: text.let(text.clean_text(v), lambda d: F.when((F.length(d) > 10) & ~text.is_generic_name(d), d))
    return F.coalesce(fine(c["og_description"]), fine(c["description"]), fine(c["twitter_description"]))


def canonical(c: Column, url: Column, extended: bool = False) -> Column:
    found = urls.absolute(url, c["canonical"], strict=not extended)
    return F.when(~F.regexp_like(found, F.lit("^https?:///")), found) if extended else found


def extract(pages: DataFrame, profile: str = STRICT, url_col: str = "url", html_col: str = "html", organisation: Callable[[Column], Column] | None = None) -> DataFrame:
    """``pages`` with a record's nine fields for each page; nothing is shuffled.

    A page without html has null fields and empty lists. Copies of a page can
    be parsed once by ``once_per_content``.
    """
    more = profile == EXTENDED
    if profile not in (STRICT, EXTENDED):
        raise ValueError(f"no such profile: {profile}")
    walked = pages.withColumn("c_", dom.raw_candidates(F.coalesce(F.col(html_col), F.lit("")), more))
    c, url = F.col("c_"), F.col(url_col)
    out = walked.withColumns({
        "company_name": company_name_extended(c, url) if more else company_name(c, organisation),
        "phone_numbers": phones(c, more), "emails": emails(c, more), "addresses": addresses(c, more), "social_media_links": social_links(c, url, more),
        "description": description(c), "canonical_url": canonical(c, url, more), "scraped_from_url": url,
    })
    site = urls.website_extended(F.col("canonical_url"), url) if more else urls.website(url)
    return out.withColumn("website", site).drop("c_")


def once_per_content(pages: DataFrame, step, html_col: str = "html") -> DataFrame:
    """``step`` on one page of each content, joined back to all pages with it.

    ``step`` takes ``(md5, html)`` and returns columns beside md5.
    """
    keyed = pages.withColumn("md5", F.md5(F.col(html_col).cast("binary")))
    distinct = keyed.groupBy("md5").agg(F.first(html_col).alias(html_col))
    return keyed.join(step(distinct).drop(html_col), "md5", "left")


def worth_keeping(records: DataFrame) -> DataFrame:
    """Records with a name, an e-mail or a phone."""
    return records.where(text.filled(F.col("company_name")) | text.has(F.col("emails")) | text.has(F.col("phone_numbers")))
