"""Phones, e-mails and social profiles: predicates and parsers as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from contactloom.functions.text import clean_text, deobfuscate, emails_in, let, normalize_email
from contactloom.functions.urls import authority, path
from contactloom.lexicons import (
    GENERIC_SOCIAL_PATHS, PHONE_LABELS, PLACEHOLDER_ADDRESSES, PLACEHOLDER_EMAIL_DOMAINS, PLACEHOLDER_EMAILS, PLACEHOLDER_PHONES, PLACEHOLDER_TLD_NAMES, PLACEHOLDER_TLDS, PLATFORMS, VANITY_WORDS,
)

PHONE_FORMS = (
    r"(?i)\+?1?[-.\s]?\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})",
    r"(?i)\+?(\d{1,3})[-.\s]?(\d{3,4})[-.\s]?(\d{3,4})[-.\s]?(\d{3,4})",
    r"(?i)\b1[-.\s]?800[-.\s]?[A-Z]{3}[-.\s]?[A-Z]{4}\b",
)
CLOUDFLARE = "/cdn-cgi/l/email-protection#"
#: placeholder phones, letters and digits only
PLAIN_PHONES = tuple(dict.fromkeys(re.sub("[^0-9a-z]", "", x.lower()) for x in PLACEHOLDER_PHONES))


def is_generic_phone(c: Column, contained: bool = False) -> Column:
    """Whether a number is a placeholder, or seven digits or more all alike; ``contained`` (extended) also if it holds one as written."""
    norm = F.lower(F.regexp_replace(c, "[^0-9A-Za-z]", ""))
    alike = let(F.regexp_replace(c, "[^0-9]", ""), lambda d: (F.length(d) >= 7) & (F.length(F.replace(d, F.substring(d, 1, 1), F.lit(""))) == 0))
    listed = norm.isin(*PLAIN_PHONES)
    if contained:
        listed = listed | F.regexp_like(F.lower(c), F.lit("|".join(rf"\Q{x}\E" for x in PLACEHOLDER_PHONES)))
    return F.coalesce(listed | alike, F.lit(False))


def is_generic_email(c: Column, extended: bool = False) -> Column:
    """Whether an address is a placeholder, by itself, its domain or its top-level domain.

    In the extended profile the top-level domain counts only below a generic name.
    """
    e = F.lower(c)
    domain = F.get(F.split(e, "@"), F.lit(1))
    ending = F.regexp_like(domain, F.lit("(" + "|".join(t.replace(".", r"\.") for t in PLACEHOLDER_TLDS) + ")$"))
    if extended:
        ending = ending & F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1).isin(*PLACEHOLDER_EMAIL_DOMAINS, *PLACEHOLDER_TLD_NAMES)
    return F.coalesce(e.isin(*PLACEHOLDER_EMAILS), F.lit(False)) | F.coalesce(domain.isin(*PLACEHOLDER_EMAIL_DOMAINS) | ending, F.lit(False))


def decode_cloudflare(c: Column) -> Column:
    """The address behind a protected link: hex bytes, each but the first XORed with the first; null if it is no such code."""
    h = F.when(F.startswith(c, F.lit(CLOUDFLARE)), F.substring_index(c, "#", -1)).otherwise(c)
    fine = F.regexp_like(h, F.lit("^[0-9a-fA-F]{2}([0-9a-fA-F]{2})*$"))
    # the pairs are cut out by a pattern, so the fold needs no index into the text
    pairs = F.regexp_extract_all(F.when(fine, h), F.lit("[0-9a-fA-F]{2}"), F.lit(0))
    values = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))
    return let(values, lambda v: F.array_join(F.transform(F.slice(v, 2, F.size(v)), lambda b: F.char(b.bitwiseXOR(F.element_at(v, 1)))), ""))


def clean_phone(c: Column) -> Column:
    """Labels and extensions off, spaces collapsed, upper-case words of a vanity number run together."""
    x = F.regexp_replace(c, r"(?i)^(?:phone|tel|call|fax):?\s*", "")
    x = F.regexp_replace(x, r"(?i)\s*(?:ext|x|extension)\.?\s*\d+\s*$", "")
    x = F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), "^ | $", "")
    return F.regexp_replace(x, r"(?<=(?:^| )[A-Z]{2,20}) (?=[A-Z]{2,}(?: |$))", "")


def clean_phone_extended(c: Column) -> Column:
    """More of what surrounds a number taken off: labels, extensions, words that trail it; its parts joined by hyphens.

    A word trails if it is all letters, belongs to no vanity number and follows
    letters or digits. Letters of vanity numbers are run together in upper case.
    """
    x = F.trim(F.regexp_replace(c, rf"(?i)^(?:{'|'.join(PHONE_LABELS)})[\s:.\-]*", ""))
    extension = F.regexp_replace(x, r"(?i)\s*(?:ext|extension|#)\.?\s*\d{1,5}\s*$", "")
    x = F.trim(F.when(extension != x, extension).otherwise(F.regexp_replace(x, r"(?i)\s+x\.?\s*\d{1,5}\s*$", "")))
    x = F.regexp_replace(x, rf"(?i)(?:(?<=[0-9A-Za-z-]{{2}})\s+[.,;:!?()]*(?!(?:{'|'.join(VANITY_WORDS)})\b)\p{{L}}{{2,}}[.,;:!?()]*)+$", "")
    x = F.upper(F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*-\s*", " - "), r"\s+", " ")))
    x = F.regexp_replace(x, r"(?<=(?:^| )[A-Z]{2,20}) (?=[A-Z]{2,}(?: |$))", "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?<=[0-9A-Z]) (?=[0-9A-Z])", "-"), " ", ""), "--", "-")
    x = F.when(F.startswith(x, F.lit("+")), F.nullif(F.concat(F.lit("+"), F.regexp_replace(F.substring(x, 2, 1_000_000), r"^[^\w-]+|[^\w-]+$", "")), F.lit("+"))).otherwise(F.regexp_replace(x, r"^[^\w+-]+|[^\w-]+$", ""))
    return F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("TOLL-FREE"), F.lit("TOLLFREE")), F.lit("FLOW-ERS"), F.lit("FLOWERS"))


def to_e164(c: Column) -> Column:
    """A number in E.164, or null if it is none, or a placeholder.

    Without a plus it is read as North American: ten digits, or eleven with a
    leading 1, area and exchange from 2 up; letters count as on a keypad. With
    a plus and another country code, 8 to 15 digits are taken as they are.
    """

    def read(x: Column) -> Column:
        keyed = F.translate(F.upper(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")
        plus = F.startswith(x, F.lit("+"))

        def number(digits: Column) -> Column:
            local = F.when(F.regexp_like(digits, F.lit("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")) & (~plus | F.startswith(digits, F.lit("1"))), F.concat(F.lit("+1"), F.right(digits, F.lit(10))))
            foreign = F.when(plus & F.regexp_like(digits, F.lit("^[2-9][0-9]{7,14}$")) & ~F.regexp_like(x, F.lit("[A-Za-z]")), F.concat(F.lit("+"), digits))
            return F.coalesce(local, foreign)

        return F.when(~is_generic_phone(x), let(F.regexp_replace(keyed, "[^0-9]", ""), number))

    return let(clean_phone(c), read)


def parse_phone(c: Column) -> Column:
    """A number of seven digits or more that neither is nor holds a placeholder, in E.164; null for all else."""
    return let(F.trim(c), lambda x: F.when((F.length(F.regexp_replace(x, "[^0-9]", "")) >= 7) & ~is_generic_phone(x, True), to_e164(x)))


def scanned_phones(c: Column) -> Column:
    """Numbers that the phone forms find in a text, checked as written and as parsed; in order, repeats included."""

    def read(m: Column) -> Column:
        return let(to_e164(m), lambda e: F.when(~is_generic_phone(clean_phone_extended(m), True) & ~is_generic_phone(e, True), parse_phone(e)))

    return F.transform(phone_candidates(c), read)


def linked_phones(href: Column) -> Column:
    """The number of a ``tel:`` link."""
    return let(clean_phone_extended(F.replace(href, F.lit("tel:"), F.lit(""))), parse_phone)


def first_seen(c: Column) -> Column:
    """Distinct values in the order they were first seen, without nulls."""
    return F.array_distinct(F.filter(c, lambda x: x.isNotNull()))


def distinct_sorted(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))


def phone_candidates(c: Column) -> Column:
    """All matches of the phone forms in a text."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)) for p in PHONE_FORMS])


def phones_in(c: Column) -> Column:
    """Distinct valid numbers in a text, sorted."""
    return distinct_sorted(F.transform(phone_candidates(c), to_e164))


def emails_of_text(c: Column) -> Column:
    """Distinct addresses of a text, hidden ones too, without placeholders."""
    return F.filter(emails_in(deobfuscate(c)), lambda e: ~is_generic_email(e))


def mail_link(href: Column) -> Column:
    """The address of a ``mailto:`` link, without placeholders."""
    raw = clean_text(F.substring_index(F.replace(href, F.lit("mailto:"), F.lit("")), "?", 1))
    return F.when(F.startswith(href, F.lit("mailto:")), let(raw, lambda r: F.when(~is_generic_email(r), normalize_email(r))))


def protected_link(href: Column) -> Column:
    """The address of a protected link, without placeholders; null too if what is decoded is no address."""
    return F.when(F.contains(href, F.lit("email-protection")), let(decode_cloudflare(href), lambda r: F.when(~is_generic_email(r), normalize_email(r))))


def address_shaped(c: Column) -> Column:
    """Whether a text of ten characters or more reads like a postal address."""
    return F.coalesce((F.length(c) >= 10) & (F.regexp_like(c, F.lit(r"(?U)\d+\s+\w+.*\b[A-Z]{2}\b\s+\d{5}")) | F.regexp_like(c, F.lit(r"(?U)\d+.*\w+.*\d{5}"))), F.lit(False))


_STREETS = "street|st|avenue|ave|road|rd|boulevard|blvd|drive|dr|lane|ln|way|court|ct|place|pl|square|sq|parkway|pkwy|highway|hwy|terrace|ter|circle|cir"
_UNITS = "apt|apartment|suite|ste|unit|floor|fl|room|rm"
#: house number, road, unit, box, city, region, code, country
US_ADDRESS = (
    rf"(?i)(?:\b(\d+[a-z]?(?:-\d+)?)\s+([^,\d][^,]*?)(?:,?\s+((?:(?:{_UNITS})\b\.?\s*#?\s*|#\s*)[\w-]+))?|\bp\.?\s*o\.?\s*box\s+(\w+))"
    rf"(?:\s*,\s*|(?<=\b(?:{_STREETS})\.?)\s+)([a-z][^,\d]*?)\s*,?\s+([a-z]{{2}})\b\.?,?\s+(\d{{5}}(?:-\d{{4}})?)\b(?:,?\s*\b(usa|us|united states(?: of america)?)\b)?"
)


def parse_address(c: Column) -> Column:
    """The parts of the first US address in a text: house_number, road, unit, po_box, city, state, postcode, country; null if there is none, or the text is a placeholder.

    The city stands after a comma, or after a road that ends in a word for one.
    """
    names = ("house_number", "road", "unit", "po_box", "city", "state", "postcode")

    def read(x: Column) -> Column:
        part = lambda k: F.nullif(F.trim(F.regexp_extract(x, US_ADDRESS, k)), F.lit(""))
        parts = F.struct(*[part(k + 1).alias(n) for k, n in enumerate(names)], F.lit("US").alias("country"))
        return F.when(F.regexp_like(x, F.lit(US_ADDRESS)) & ~F.lower(x).isin(*PLACEHOLDER_ADDRESSES), parts)

    return let(clean_text(c), read)


def format_address(a: Column) -> Column:
    """Parts as one line: house, road and unit, or the box; city, region with code; the country if it is another."""

    def line(a: Column) -> Column:
        road = F.when(a["road"].isNotNull(), F.concat_ws(" ", a["house_number"], a["road"], a["unit"])).otherwise(F.concat(F.lit("PO Box "), a["po_box"]))
        area = F.nullif(F.concat_ws(", ", a["city"], F.nullif(F.concat_ws(" ", a["state"], a["postcode"]), F.lit(""))), F.lit(""))
        abroad = F.when(~F.upper(a["country"]).isin("US", "USA", "UNITED STATES", "UNITED STATES OF AMERICA"), a["country"])
        return F.when(road.isNotNull() & (a["city"].isNotNull() | a["postcode"].isNotNull()), F.concat_ws(", ", road, area, abroad))

    return let(a, line)


def postal_address(street: Column, city: Column, region: Column, code: Column) -> Column:
    """Marked-up parts as one line, if there are two parts or more."""
    tail = F.coalesce(F.concat_ws(" ", region, code), F.lit(""))
    parts = F.filter(F.array(street, city, F.nullif(tail, F.lit(""))), lambda p: p.isNotNull())
    return F.when(F.size(parts) >= 2, F.array_join(parts, ", "))


def _stripped(c: Column) -> Column:
    return F.regexp_replace(c, "^/+|/+$", "")


def is_social(url: Column, platform: str, extended: bool = False) -> Column:
    """Whether a url is a profile on a platform.

    Strict: hosts are compared with every ``www.`` taken out; a path that holds
    an excluded part fails; where path starts are listed the path has to begin
    with one of them (slashes stripped), elsewhere its first part has to look
    like a user name. Extended: either will do, Facebook's ``profile.php?id=``
    counts, and generic paths are excluded too.
    """
    return let(_parts(url), lambda u: _is_profile(u, platform, extended))


def _parts(url: Column) -> Column:
    """What of a url the platforms look at."""
    p = _stripped(path(url))
    return F.struct(F.replace(F.lower(authority(url)), F.lit("www."), F.lit("")).alias("host"), p.alias("path"), F.lower(p).alias("low"), F.substring_index(p, "/", 1).alias("user"), url.alias("url"))


def _is_profile(u: Column, platform: str, extended: bool) -> Column:
    _, hosts, starts, excluded, form = next(p for p in PLATFORMS if p[0] == platform)
    fine = u["host"].isin(*hosts)
    for x in excluded:
        fine = fine & ~F.contains(u["low"], F.lit(x))
    user = u["user"]
    if platform == "tiktok":
        user = F.when(F.startswith(user, F.lit("@")), user).otherwise(F.concat(F.lit("@"), user))
    begins = None
    for s in starts:
        begins = F.startswith(u["path"], F.lit(s)) if begins is None else begins | F.startswith(u["path"], F.lit(s))
    named = F.regexp_like(user, F.lit(form)) if form else None
    if not extended:
        return F.coalesce(fine & (begins if begins is not None else named), F.lit(False))
    either = [x for x in (begins, named) if x is not None]
    shaped = either[0] if len(either) == 1 else either[0] | either[1]
    if platform == "facebook":
        shaped = shaped | F.regexp_like(u["url"], F.lit(r"/profile\.php\?id=\d+"))
    generic = F.lower(user).isin(*[x.strip("/") for x in GENERIC_SOCIAL_PATHS if platform != "linkedin"])
    return F.coalesce(fine & shaped & ~(F.coalesce(generic, F.lit(False)) & ~(begins if begins is not None else F.lit(False))), F.lit(False))


def social_platform(url: Column, extended: bool = False) -> Column:
    """The first platform of which a url is a profile, or null."""

    def first(u: Column) -> Column:
        found = None
        for name, *_ in PLATFORMS:
            hit = _is_profile(u, name, extended)
            found = F.when(hit, name) if found is None else found.when(hit, name)
        return found

    return let(_parts(url), first)
