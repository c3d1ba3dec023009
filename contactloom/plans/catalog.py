"""Registered queries of the engine, each with its SQL oracle where one exists.

Fixtures that the driver's tables lack (markup, listings, fetch logs) are made
from their columns by expressions that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom import lexicons as L
from contactloom.functions import contacts as C
from contactloom.functions import markup, text, urls
from contactloom.operators import directory, extract, fetch, report, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAGES_A_TASK = 2_000


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt to a task for every PAGES_A_TASK, and to one a core at least.

    A table that pages are made from is small, so one task would read it and walk all pages; its bytes say nothing of that work.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PAGES_A_TASK)))


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- pages by patterns

_HOST = "nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '')"


def _decoded(x: str) -> str:
    for name, sign in markup.ENTITIES:
        x = f"replace({x}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return x


def _clean(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace({x}, '\\s+', ' ', 'g'), '^ | $', '', 'g'), '')"


def _tag(tag: str) -> str:
    return _clean(_decoded(f"regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)(?:</{tag}\\s*>|$)', 1), '(?s)<[^>]*>', ' ', 'g')"))


_GENERIC = quoted(L.GENERIC_NAMES)
_NAMES = f"""
WITH t AS (SELECT page_id, url, {_tag('title')} AS title, {_tag('footer')} AS footer FROM pages),
p AS (SELECT *, regexp_split_to_array(title, '\\s*[\\|\\-–—]\\s*') AS parts,
      {_clean("regexp_extract(footer, '(?i)©\\s*(?:[0-9]{4}[-\\s]?[0-9]{4}|[0-9]{4})?\\s*([^.,\\n]+?)(?:\\s*(?:All Rights Reserved|Inc\\.?|LLC|Ltd\\.?|Corp\\.?))?(?:\\.|$)', 1)")} AS holder_ FROM t),
n AS (SELECT page_id, url, title, CASE WHEN lower(title) NOT IN ({_GENERIC}) AND len(parts) > 1 THEN {_clean("parts[len(parts)]")} END AS part_,
      CASE WHEN lower(holder_) NOT IN ({_GENERIC}) THEN holder_ END AS holder FROM p),
c AS (SELECT page_id, url, title, holder, CASE WHEN lower(part_) NOT IN ({_GENERIC}) THEN part_ END AS part FROM n)
"""


def page_names(pages: DataFrame) -> DataFrame:
    title = text.clean_text(markup.tag_text(F.col("html"), "title"))
    footer = text.clean_text(markup.tag_text(F.col("html"), "footer"))
    read = pages.select("page_id", "url", title.alias("title"), footer.alias("footer"))
    return read.select("page_id", "url", "title", text.company_in_title(F.col("title")).alias("part"), text.copyright_holder(F.col("footer")).alias("holder"))


@query(_NAMES + "SELECT page_id, part AS company FROM c WHERE part IS NOT NULL")
def title_company(spark, sf_dir):
    """T12, F9."""
    return page_names(table(spark, sf_dir, "pages")).where("part is not null").select("page_id", F.col("part").alias("company"))


@query(_NAMES + "SELECT page_id, holder FROM c WHERE holder IS NOT NULL")
def footer_company(spark, sf_dir):
    """T13, F9."""
    return page_names(table(spark, sf_dir, "pages")).where("holder is not null").select("page_id", "holder")


@query(_NAMES + "SELECT page_id, coalesce(part, holder) AS company_name FROM c")
def company_name_ranked(spark, sf_dir):
    """E1 and W3 over what a pattern reads."""
    return page_names(table(spark, sf_dir, "pages")).select("page_id", F.coalesce("part", "holder").alias("company_name"))


@query(_NAMES + f", h AS (SELECT *, {_HOST} AS host FROM c) SELECT host, count(*) AS n_pages, count(coalesce(part, holder)) AS n_named, min(coalesce(part, holder)) AS first_name, count(title) AS n_titled FROM h WHERE regexp_matches(trim(url), '^https?://') GROUP BY host")
def site_profile(spark, sf_dir):
    """Named pages per site: F1, T15, E1, A1."""
    named = page_names(table(spark, sf_dir, "pages").where(urls.is_http(F.col("url"))))
    name = F.coalesce("part", "holder")
    return named.groupBy(urls.authority(F.col("url")).alias("host")).agg(F.count("*").alias("n_pages"), F.count(name).alias("n_named"), F.min(name).alias("first_name"), F.count("title").alias("n_titled"))


@query(f"""
WITH p AS (SELECT page_id, url, {_HOST} AS authority FROM pages)
SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme, authority, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || authority AS site,
       regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM p""")
def url_parts(spark, sf_dir):
    """T14, T15."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.scheme(u).alias("scheme"), urls.authority(u).alias("authority"), urls.site(u).alias("site"), urls.path(u).alias("path"))


_URLS = "CASE s_suppkey % 6 WHEN 0 THEN 'https://www.shop' || s_suppkey || '.co.uk/a' WHEN 1 THEN 'http://a.b.firm' || s_suppkey || '.com:8080/x?y=1' WHEN 2 THEN 'http://10.0.0.' || (s_suppkey % 250) || '/' WHEN 3 THEN 'mailto:x@firm' || s_suppkey || '.com' WHEN 4 THEN 'localhost' ELSE 'plain' || s_suppkey || '.org' END"


@query(f"""
WITH u AS (SELECT s_suppkey, {_URLS} AS url FROM supplier),
h AS (SELECT *, lower(regexp_replace(regexp_extract(CASE WHEN contains(url, '://') THEN url ELSE 'http://' || url END, '^[a-z]+://([^/?#]*)', 1), '^[^@]*@|:[0-9]*$', '', 'g')) AS host FROM u),
s AS (SELECT *, string_split(host, '.') AS l FROM h),
n AS (SELECT s_suppkey, url, host, CASE WHEN starts_with(url, 'mailto:') THEN NULL WHEN regexp_matches(host, '^[0-9.]+$') OR host = 'localhost' THEN host
      WHEN len(l) > 2 AND array_to_string(l[-2:], '.') IN ({quoted(L.LONG_SUFFIXES)}) THEN array_to_string(l[-3:], '.') WHEN len(l) > 1 THEN array_to_string(l[-2:], '.') END AS domain FROM s)
SELECT s_suppkey, url, domain, CASE WHEN domain IS NOT NULL THEN host END AS whole FROM n""")
def registered_domain(spark, sf_dir):
    """T4, F14."""
    u = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_URLS} AS url")
    return u.select("s_suppkey", "url", urls.registered_domain(F.col("url")).alias("domain"), urls.registered_domain(F.col("url"), True).alias("whole"))


@query(f"""
WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS link, count(*) AS n FROM a WHERE starts_with(href, '/') GROUP BY ALL""")
def absolute_links(spark, sf_dir):
    """T5 over the anchors of pages."""
    a = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(markup.hrefs(F.col("html"))).alias("href")).where("href like '/%'")
    return a.select("page_id", "href", urls.absolute(F.col("url"), F.col("href"), general=False).alias("link")).groupBy("page_id", "href", "link").agg(F.count("*").alias("n"))


_SITES = "CASE s_suppkey % 4 WHEN 0 THEN 'https://example.com/p' WHEN 1 THEN 'http://www.example.com/' WHEN 2 THEN 'https://Test.com' ELSE 'https://firm' || s_suppkey || '.com/about' END"


@query(f"""
WITH u AS (SELECT s_suppkey, {_SITES} AS url FROM supplier), h AS (SELECT *, {_HOST} AS host FROM u)
SELECT s_suppkey, CASE WHEN lower(host) NOT IN ({quoted(L.PLACEHOLDER_SITES)}) THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) END AS website FROM h""")
def placeholder_sites(spark, sf_dir):
    """F10, E8."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_SITES} AS url").select("s_suppkey", urls.website(F.col("url")).alias("website"))


_SEEDS = "CASE page_id % 5 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN 'ftp://x/' || page_id WHEN 2 THEN '' WHEN 3 THEN upper(url) ELSE url END"


@query(f"SELECT page_id, trim(u) AS url FROM (SELECT page_id, {_SEEDS} AS u FROM pages) WHERE regexp_matches(trim(u), '^https?://')")
def seed_url_filter(spark, sf_dir):
    """S1, F1."""
    seeds = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_SEEDS} AS u")
    return seeds.where(urls.is_http(F.col("u"))).select("page_id", F.trim("u").alias("url"))


# --- text


@query(f"SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, {_clean('text')} AS c FROM documents)")
def clean_text_docs(spark, sf_dir):
    """T1."""
    c = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("digest"))


@query(f"SELECT doc_id, md5(translate(text, '{text.DASHES}', '{'-' * len(text.DASHES)}')) AS digest FROM documents")
def hyphen_normalize_docs(spark, sf_dir):
    """T6."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.plain_hyphens(F.col("text")).cast("binary")).alias("digest"))


_EMAIL = text.EMAIL.replace("'", "''")
_EMAIL_RULE = f"e NOT IN ({quoted(L.PLACEHOLDER_EMAILS)}) AND split_part(e, '@', 2) NOT IN ({quoted(L.PLACEHOLDER_EMAIL_DOMAINS)}) AND NOT regexp_matches(split_part(e, '@', 2), '(\\.test|\\.example|\\.localhost|\\.invalid)$')"


@query(f"SELECT DISTINCT doc_id, e AS email FROM (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda x: lower(x))) AS e FROM documents) WHERE {_EMAIL_RULE}")
def emails_from_docs(spark, sf_dir):
    """T2, T3, F8, J6."""
    found = F.filter(text.emails_in(F.col("text")), lambda e: ~C.is_generic_email(e))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email"))


_HIDDEN = "'mail user' || c_custkey || ' [at] firm' || (c_custkey % 7) || ' [DOT] org, or Sales(at)shop' || c_custkey || '(dot)net or meet us at acme.com'"


@query("""
SELECT c_custkey, unnest(['user' || c_custkey || '@firm' || (c_custkey % 7) || '.org', 'sales@shop' || c_custkey || '.net', 'us@acme.com']) AS email FROM customer""")
def emails_deobfuscated(spark, sf_dir):
    """T9, T3."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_HIDDEN} AS t").select("c_custkey", F.explode(C.emails_of_text(F.col("t"))).alias("email"))


@query("SELECT s_suppkey, 'sales' || s_suppkey || '@acme.org' AS email FROM supplier")
def cloudflare_decode(spark, sf_dir):
    """Addresses are protected, then read again."""
    mail = "concat('sales', s_suppkey, '@acme.org')"
    coded = f"concat('{C.CLOUDFLARE}', lower(lpad(hex(s_suppkey % 256), 2, '0')), array_join(transform(regexp_extract_all({mail}, '.', 0), x -> lower(lpad(hex(ascii(x) ^ (s_suppkey % 256)), 2, '0'))), ''))"
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.decode_cloudflare(F.expr(coded)).alias("email"))


def _e164(x: str) -> str:
    digits = f"regexp_replace(translate(upper({x}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '22233344455566677778889999'), '[^0-9]', '', 'g')"
    norm = f"lower(regexp_replace({x}, '[^0-9A-Za-z]', '', 'g'))"
    d = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    return f"""CASE WHEN {norm} IN ({quoted(C.PLAIN_PHONES)}) OR (length({d}) >= 7 AND length(replace({d}, left({d}, 1), '')) = 0) THEN NULL
      WHEN regexp_matches({digits}, '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$') AND (NOT starts_with({x}, '+') OR starts_with({digits}, '1')) THEN '+1' || right({digits}, 10)
      WHEN starts_with({x}, '+') AND regexp_matches({digits}, '^[2-9][0-9]{{7,14}}$') AND NOT regexp_matches({x}, '[A-Za-z]') THEN '+' || {digits} END"""


@query(f"""
WITH m AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(text, '{C.PHONE_FORMS[0]}', 0), regexp_extract_all(text, '{C.PHONE_FORMS[1]}', 0), regexp_extract_all(text, '{C.PHONE_FORMS[2]}', 0))) AS m FROM documents),
x AS (SELECT doc_id, regexp_replace(regexp_replace(m, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS x FROM m)
SELECT DISTINCT doc_id, phone FROM (SELECT doc_id, {_e164('x')} AS phone FROM x) WHERE phone IS NOT NULL""")
def phones_from_docs(spark, sf_dir):
    """T10, T11, F7, J6, N8."""
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.phones_in(F.col("text"))).alias("phone"))


_PHONES = "CASE c_custkey % 8 WHEN 0 THEN '(415) 5' || right('00' || (c_custkey % 100), 2) || '-' || right('0000' || c_custkey, 4) WHEN 1 THEN '555-555-5555' WHEN 2 THEN '1-800-FLOWERS' WHEN 3 THEN '+44 20 7946 ' || right('0000' || c_custkey, 4) WHEN 4 THEN '12' WHEN 5 THEN '800-555-0100' WHEN 6 THEN '1.212.555.' || right('0000' || c_custkey, 4) ELSE '999 9999' END"


@query(f"SELECT c_custkey, raw, {_e164('raw')} AS phone FROM (SELECT c_custkey, {_PHONES} AS raw FROM customer)")
def phone_forms(spark, sf_dir):
    """T10, T11, F7 on the usual ways of writing."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PHONES} AS raw").select("c_custkey", "raw", C.to_e164(F.col("raw")).alias("phone"))


_MAILS = "CASE s_suppkey % 6 WHEN 0 THEN 'Info@Example.com' WHEN 1 THEN 'me@mail5.example.com' WHEN 2 THEN 'a@b.test' WHEN 3 THEN 'x@domain.com' WHEN 4 THEN 'no-at-sign' ELSE 'sales@firm' || s_suppkey || '.com' END"


@query(f"SELECT s_suppkey, e, NOT ({_EMAIL_RULE.replace('e NOT', 'lower(e) NOT').replace('split_part(e', 'split_part(lower(e)')}) AS generic FROM (SELECT s_suppkey, {_MAILS} AS e FROM supplier)")
def generic_email_flag(spark, sf_dir):
    """F8."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_MAILS} AS e").select("s_suppkey", "e", C.is_generic_email(F.col("e")).alias("generic"))


_ADDRESS = "CASE s_suppkey % 4 WHEN 0 THEN s_suppkey || ' Main Road, Austin TX 75001' WHEN 1 THEN 'Box 12' WHEN 2 THEN 'Suite ' || s_suppkey || ' somewhere, no code' ELSE 'No. 7, Platz 1, 10' || right('000' || (s_suppkey % 1000), 3) || ' Berlin' END"


@query(f"SELECT s_suppkey, length(a) >= 10 AND (regexp_matches(a, '\\d+\\s+\\w+.*\\b[A-Z]{{2}}\\b\\s+\\d{{5}}') OR regexp_matches(a, '\\d+.*\\w+.*\\d{{5}}')) AS shaped FROM (SELECT s_suppkey, {_ADDRESS} AS a FROM supplier)")
def address_shape_flag(spark, sf_dir):
    """F16."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_ADDRESS} AS a").select("s_suppkey", C.address_shaped(F.col("a")).alias("shaped"))


@query(f"SELECT page_id, coalesce(regexp_matches(lower({_clean('left(h, 2500)')}), 'captcha|are you a robot|verify you.re human|turnstile'), FALSE) AS captcha FROM (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN replace(html, '<body>', '<body>Please solve the reCAPTCHA.') ELSE html END AS h FROM pages)")
def captcha_flag(spark, sf_dir):
    """F13."""
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE WHEN page_id % 9 = 0 THEN replace(html, '<body>', '<body>Please solve the reCAPTCHA.') ELSE html END AS html")
    return fetch.flagged(pages).select("page_id", "captcha")


# --- whole pages, walked

_K = "s_suppkey"
_HTML = f"""'<html><head><title>Home | Firm ' || {_K} || '</title>' ||
CASE WHEN {_K} % 2 = 0 THEN '<meta property="og:site_name" content=" Firm  ' || {_K} || ' Ltd ">' ELSE '' END ||
CASE WHEN {_K} % 3 = 0 THEN '<meta name="description" content="We make things since ' || {_K} || '.">' ELSE '<meta property="og:description" content="short">' END ||
CASE WHEN {_K} % 5 = 0 THEN '<link rel="canonical" href="/about/' || {_K} || '">' ELSE '' END ||
'</head><body><div class="contact"><p>Call <b>(415) 555-' || right('0000' || {_K}, 4) || '</b> or <a href="mailto:Office' || {_K} || '@firm.org?subject=x">write</a></p>' ||
'<a href="https://www.linkedin.com/company/firm' || {_K} || '">in</a><a href="https://twitter.com/firm' || {_K} || '">tw</a><a href="https://x.com/second">x</a><a href="https://facebook.com/firm">fb</a></div>' ||
'<address itemtype="http://schema.org/PostalAddress"><span itemprop="streetAddress">' || {_K} || ' Elm Street</span> <span itemprop="addressLocality">Austin</span> <span itemprop="addressRegion">TX</span> <span itemprop="postalCode">75001</span></address>' ||
'<footer>&copy; 2024 Firm ' || {_K} || ' Inc.</footer></body></html>'"""


def made_pages(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "supplier").select("s_suppkey")).selectExpr("s_suppkey", f"concat('https://www.firm', s_suppkey, '.org/index.html') AS url", f"{_HTML} AS html")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Firm ' || s_suppkey || ' Ltd' ELSE 'Firm ' || s_suppkey END AS company_name, '+1415555' || right('0000' || s_suppkey, 4) AS phones,
       'office' || s_suppkey || '@firm.org' AS emails, s_suppkey || ' Elm Street Austin TX 75001; ' || s_suppkey || ' Elm Street, Austin, TX 75001' AS addresses,
       'linkedin=https://www.linkedin.com/company/firm' || s_suppkey || ';twitter=https://twitter.com/firm' || s_suppkey AS social,
       CASE WHEN s_suppkey % 3 = 0 THEN 'We make things since ' || s_suppkey || '.' END AS description,
       CASE WHEN s_suppkey % 5 = 0 THEN 'https://www.firm' || s_suppkey || '.org/about/' || s_suppkey END AS canonical_url, 'https://www.firm' || s_suppkey || '.org' AS website
FROM supplier""")
def page_records(spark, sf_dir):
    """E1 to E8 and T16 through the page walk, strict."""
    return _shown(extract.worth_keeping(extract.extract(made_pages(spark, sf_dir))))


_HOLDS_PLACEHOLDER = "'555-' || right('0000' || s_suppkey, 4) IN ('555-0100', '555-0101', '555-0199')"


@query(f"""
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Firm ' || s_suppkey || ' Ltd' ELSE 'Firm ' || s_suppkey END AS company_name, CASE WHEN {_HOLDS_PLACEHOLDER} THEN '' ELSE '+1415555' || right('0000' || s_suppkey, 4) END AS phones,
       'office' || s_suppkey || '@firm.org' AS emails, s_suppkey || ' Elm Street, Austin, TX 75001' AS addresses,
       'facebook=https://facebook.com/firm;linkedin=https://www.linkedin.com/company/firm' || s_suppkey || ';twitter=https://twitter.com/firm' || s_suppkey AS social,
       CASE WHEN s_suppkey % 3 = 0 THEN 'We make things since ' || s_suppkey || '.' END AS description,
       CASE WHEN s_suppkey % 5 = 0 THEN 'https://www.firm' || s_suppkey || '.org/about/' || s_suppkey END AS canonical_url, 'https://www.firm' || s_suppkey || '.org' AS website
FROM supplier""")
def page_records_extended(spark, sf_dir):
    """X1, X4, X11, X12, X14, X16 through the page walk."""
    return _shown(extract.worth_keeping(extract.extract(made_pages(spark, sf_dir), extract.EXTENDED)))


_WIDE = f"""'<html><head><title>News</title><link rel="canonical" href="https://main' || {_K} || '.org/x"><meta itemprop="x"></head><body itemscope itemtype="http://schema.org/LocalBusiness"><h1 itemprop="legalName">Alpha ' || {_K} || ' Works</h1>' ||
'<ul><li>Tel. 212-555-' || right('0000' || {_K}, 4) || ' x12</li><li>555-0100</li></ul><table><tr><td>write x' || {_K} || ' AT firm DOT org , or z@mail.test</td></tr></table>' ||
'<p class="location">' || {_K} || ' Main Road , Suite 5, Boston, MA 02101</p><a href="tel:Phone: 415-555-' || right('0000' || {_K}, 4) || ' office">ring</a><a href="https://www.facebook.com/profile.php?id=' || {_K} || '">f</a></body></html>'"""


@query(f"""
SELECT s_suppkey, 'Alpha ' || s_suppkey || ' Works' AS company_name, CASE WHEN {_HOLDS_PLACEHOLDER} THEN '' ELSE '+1212555' || right('0000' || s_suppkey, 4) || '; +1415555' || right('0000' || s_suppkey, 4) END AS phones,
       'x' || s_suppkey || '@firm.org; z@mail.test' AS emails, s_suppkey || ' Main Road Suite 5, Boston, MA 02101' AS addresses,
       'facebook=https://www.facebook.com/profile.php?id=' || s_suppkey AS social, NULL AS description, 'https://main' || s_suppkey || '.org/x' AS canonical_url, 'https://main' || s_suppkey || '.org' AS website
FROM supplier""")
def page_records_wide(spark, sf_dir):
    """Pages of which the strict profile reads next to nothing."""
    pages = spread(table(spark, sf_dir, "supplier").select("s_suppkey")).selectExpr("s_suppkey", "concat('https://www.firm', s_suppkey, '.org/index.html') AS url", f"{_WIDE} AS html")
    return _shown(extract.extract(pages, extract.EXTENDED))


_RAW_PHONES = """CASE c_custkey % 6 WHEN 0 THEN 'Phone: (415) 555-' || right('0000' || c_custkey, 4) || ' ext. 12' WHEN 1 THEN 'call now 1 800 FLOWERS please' WHEN 2 THEN '+1 415-555-' || right('0000' || c_custkey, 4) || ' office hours'
  WHEN 3 THEN 'Fax 415 555 ' || right('0000' || c_custkey, 4) || ' x5' WHEN 4 THEN 'toll-free: 1-800-FLOW-ERS' ELSE '1 800 GOOD BOY' END"""


@query(f"""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '415)555-' || right('0000' || c_custkey, 4) WHEN 2 THEN '+1-415-555-' || right('0000' || c_custkey, 4) WHEN 3 THEN '415-555-' || right('0000' || c_custkey, 4) WHEN 5 THEN '1-800' ELSE '1-800-FLOWERS' END AS cleaned FROM customer""")
def phones_cleaned(spark, sf_dir):
    """X5."""
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_RAW_PHONES} AS raw").select("c_custkey", C.clean_phone_extended(F.col("raw")).alias("cleaned"))


_CONTAINED = f"regexp_matches(lower(raw), '{'|'.join(x.replace('(', chr(92) + '(').replace(')', chr(92) + ')').replace('.', chr(92) + '.').replace('+', chr(92) + '+') for x in L.PLACEHOLDER_PHONES)}')"


@query(f"SELECT c_custkey, raw, {_CONTAINED} OR {_e164('raw')} IS NULL AND regexp_replace(raw, '[^0-9]', '', 'g') IN ('5555555555', '8005550100', '9999999') AS generic, CASE WHEN length(regexp_replace(raw, '[^0-9]', '', 'g')) >= 7 AND NOT {_CONTAINED} THEN {_e164('raw')} END AS phone FROM (SELECT c_custkey, {_PHONES} AS raw FROM customer)")
def phones_parsed(spark, sf_dir):
    """X1, X6."""
    raw = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_PHONES} AS raw")
    return raw.select("c_custkey", "raw", C.is_generic_phone(F.col("raw"), True).alias("generic"), C.parse_phone(F.col("raw")).alias("phone"))


_PLACES = """CASE s_suppkey % 5 WHEN 0 THEN s_suppkey || ' Main Road, Apt 4, Austin, TX 75001' WHEN 1 THEN 'PO Box ' || s_suppkey || ', Boston, MA 02101-1234' WHEN 2 THEN '123 Main Street, Anytown, CA 12345'
  WHEN 3 THEN 'Visit us: ' || s_suppkey || ' Elm Street Austin TX 75001, USA' ELSE 'room ' || s_suppkey || ', no code' END"""


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN s_suppkey || '' WHEN 3 THEN s_suppkey || '' END AS house_number, CASE s_suppkey % 5 WHEN 0 THEN 'Main Road' WHEN 3 THEN 'Elm Street' END AS road, CASE s_suppkey % 5 WHEN 0 THEN 'Apt 4' END AS unit,
  CASE s_suppkey % 5 WHEN 0 THEN '75001' WHEN 1 THEN '02101-1234' WHEN 3 THEN '75001' END AS postcode,
  CASE s_suppkey % 5 WHEN 0 THEN s_suppkey || ' Main Road Apt 4, Austin, TX 75001' WHEN 1 THEN 'PO Box ' || s_suppkey || ', Boston, MA 02101-1234' WHEN 3 THEN s_suppkey || ' Elm Street, Austin, TX 75001' END AS line FROM supplier""")
def addresses_parsed(spark, sf_dir):
    """X9, X10."""
    parts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_PLACES} AS t").select("s_suppkey", C.parse_address(F.col("t")).alias("a"))
    return parts.select("s_suppkey", "a.house_number", "a.road", "a.unit", "a.postcode", C.format_address(F.col("a")).alias("line"))


@query(r"SELECT doc_id, md5(regexp_replace(replace(text, '.', ' .'), '\s+([.,;:!?])', '\1', 'g')) AS digest FROM documents")
def tight_punctuation(spark, sf_dir):
    """X3."""
    spaced = F.replace("text", F.lit("."), F.lit(" ."))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.space_before_punctuation(spaced).cast("binary")).alias("digest"))


_HARD_MAILS = "CASE s_suppkey % 6 WHEN 0 THEN 'mail a' || s_suppkey || ' AT firm DOT org' WHEN 1 THEN 'b' || s_suppkey || ' [ @ ] shop (.) net' WHEN 2 THEN 'c' || s_suppkey || ' en acme dt com' WHEN 3 THEN 'd' || s_suppkey || '＠x．org' WHEN 4 THEN 'e' || s_suppkey || '&commat;y&period;org' ELSE 'f' || s_suppkey || ' <at> z <dot> org' END"


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'a' || s_suppkey || '@firm.org' WHEN 1 THEN 'b' || s_suppkey || '@shop.net' WHEN 2 THEN 'c' || s_suppkey || '@acme.com' WHEN 3 THEN 'd' || s_suppkey || '@x.org' WHEN 4 THEN 'e' || s_suppkey || '@y.org' ELSE 'f' || s_suppkey || '@z.org' END AS email FROM supplier")
def emails_hidden_harder(spark, sf_dir):
    """X8."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_HARD_MAILS} AS t").select("s_suppkey", F.explode(text.emails_in(text.deobfuscate_extended(F.col("t")))).alias("email"))


_TLD_MAILS = "CASE s_suppkey % 5 WHEN 0 THEN 'me@yourname.test' WHEN 1 THEN 'x@mail.example' WHEN 2 THEN 'y@domain.com' WHEN 3 THEN 'z@Sample.invalid' ELSE 'sales@firm.com' END"


@query(f"SELECT s_suppkey, s_suppkey % 5 IN (0, 2, 3) AS generic FROM (SELECT s_suppkey, {_TLD_MAILS} AS e FROM supplier)")
def generic_email_extended(spark, sf_dir):
    """X2."""
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", f"{_TLD_MAILS} AS e").select("s_suppkey", C.is_generic_email(F.col("e"), True).alias("generic"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'b,a' ELSE 'c,b,a' END AS seen FROM supplier")
def first_seen_order(spark, sf_dir):
    """X15."""
    made = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "CASE WHEN s_suppkey % 2 = 0 THEN array('b', 'a', NULL, 'b') ELSE array('c', 'b', 'c', 'a', 'b') END AS v")
    return made.select("s_suppkey", F.array_join(C.first_seen(F.col("v")), ",").alias("seen"))


def _shown(records: DataFrame) -> DataFrame:
    pairs = F.transform(F.array_sort(F.map_entries("social_media_links")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return records.select(
        "s_suppkey", "company_name", F.concat_ws("; ", "phone_numbers").alias("phones"), F.concat_ws("; ", "emails").alias("emails"), F.concat_ws("; ", "addresses").alias("addresses"),
        F.array_join(pairs, ";").alias("social"), "description", "canonical_url", "website",
    )


@query("""
WITH u AS (SELECT s_suppkey, unnest(['https://www.linkedin.com/company/a' || s_suppkey, 'https://facebook.com/shop', 'https://www.facebook.com/pages/p/1', 'https://twitter.com/search?q=1', 'https://x.com/ab' || s_suppkey, 'https://www.youtube.com/watch?v=1',
  'https://youtube.com/@channel', 'https://instagram.com/some.one/', 'https://pinterest.co.uk/board_1', 'https://tiktok.com/@who', 'https://tiktok.com/who', 'https://example.org/']) AS url FROM supplier)
SELECT s_suppkey, url, CASE WHEN contains(url, 'linkedin.com/company') THEN 'linkedin' WHEN contains(url, 'x.com/ab') THEN 'twitter' WHEN contains(url, 'facebook.com/pages') THEN 'facebook' WHEN contains(url, 'instagram') THEN 'instagram'
  WHEN contains(url, '@channel') THEN 'youtube' WHEN contains(url, 'pinterest') THEN 'pinterest' WHEN contains(url, 'tiktok') THEN 'tiktok' END AS platform FROM u""")
def social_platforms(spark, sf_dir):
    """F11, N6."""
    made = "explode(array(concat('https://www.linkedin.com/company/a', s_suppkey), 'https://facebook.com/shop', 'https://www.facebook.com/pages/p/1', 'https://twitter.com/search?q=1', concat('https://x.com/ab', s_suppkey), 'https://www.youtube.com/watch?v=1', 'https://youtube.com/@channel', 'https://instagram.com/some.one/', 'https://pinterest.co.uk/board_1', 'https://tiktok.com/@who', 'https://tiktok.com/who', 'https://example.org/')) AS url"
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey", made).select("s_suppkey", "url", C.social_platform(F.col("url")).alias("platform"))


@query("SELECT md5(html) AS digest, count(*) AS n_pages, length(min(html)) AS n FROM (SELECT CASE WHEN page_id % 3 = 0 THEN 'same' ELSE html END AS html FROM pages) GROUP BY 1")
def page_memo_by_md5(spark, sf_dir):
    """The costly step runs once for each content."""
    pages = table(spark, sf_dir, "pages").selectExpr("page_id", "CASE WHEN page_id % 3 = 0 THEN 'same' ELSE html END AS html")
    done = extract.once_per_content(pages, lambda d: d.withColumn("n", F.length("html").cast("long")))
    return done.groupBy(F.col("md5").alias("digest")).agg(F.count("*").alias("n_pages"), F.max("n").alias("n"))


_MARKED = "regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<!--.*?-->', '', 'g')"
for _level in range(1, 7):
    _MARKED = f"regexp_replace({_MARKED}, '(?i)<h{_level}\\b[^>]*>', chr(10) || chr(10) || '{'#' * _level} ', 'g')"
_MARKED = f"regexp_replace({_MARKED}, '(?is)<li\\b[^>]*>', chr(10) || '- ', 'g')"
_MARKED = f"""regexp_replace({_MARKED}, '(?is)<a\\b[^>]*?href\\s*=\\s*["'']([^"'']*)["''][^>]*>(.*?)</a\\s*>', '[\\2](\\1)', 'g')"""
_MARKED = f"regexp_replace({_MARKED}, '(?is)<br\\s*/?>|</(p|div|tr|ul|ol|h[1-6]|article|section|footer|header|nav)\\s*>', chr(10), 'g')"
_MARKED = f"regexp_replace(regexp_replace({_MARKED}, '(?s)<[^>]*>', '', 'g'), '[ \\t]+', ' ', 'g')"
_MARKED = f"regexp_replace(regexp_replace({_MARKED}, '\\n\\s*\\n\\s*', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query(f"""SELECT page_id, length(t)::BIGINT AS n, md5('List the businesses on this page as JSON.' || chr(10) || chr(10) || 'URL: ' || url || chr(10) || chr(10) || t) AS digest
FROM (SELECT page_id, url, CASE WHEN length(m) > {text.PAGE_LIMIT} THEN left(m, {text.PAGE_LIMIT}) || chr(10) || chr(10) || '[Content truncated]' ELSE m END AS t FROM (SELECT page_id, url, {_MARKED} AS m FROM pages))""")
def page_markdown(spark, sf_dir):
    """Pages as prompts of bounded length."""
    body = text.shortened(text.markdown(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(body).cast("long").alias("n"), F.md5(text.prompt("List the businesses on this page as JSON.\n\nURL: %s\n\n%s", F.col("url"), body).cast("binary")).alias("digest"))


# --- listings to leads

_BUSINESS = (
    "c_custkey AS seq", "c_nationkey AS chamber_seq",
    "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '  FIRM ' || (c_custkey - c_custkey % 10) || ' ' ELSE 'Firm ' || (c_custkey - c_custkey % 2) END AS name",
    "CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'https://firm' || (c_custkey - c_custkey % 2) || '.com' ELSE 'firm' || (c_custkey - c_custkey % 2) || '.com' END AS website",
    "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '415555' || right('0000' || c_custkey, 4) END AS phone",
    "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'm' || c_custkey || '@firm.org' END AS email", "CAST(NULL AS STRING) AS address", "c_mktsegment AS industry",
    "CASE WHEN c_custkey % 2 = 0 THEN 'https://chamber' || c_nationkey || '.org/list' ELSE NULL END AS source_url", "'Chamber ' || c_nationkey AS chamber_name", "'https://chamber' || c_nationkey || '.org' AS chamber_url",
)
_B = f"WITH b AS (SELECT {', '.join(x.replace('STRING', 'VARCHAR') for x in _BUSINESS)} FROM customer), n AS (SELECT *, CASE WHEN website <> '' AND NOT regexp_matches(website, '^https?://') THEN 'https://' || website ELSE website END AS site FROM b)"


def businesses(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_BUSINESS)


@query(_B + " SELECT seq, name AS company_name, site AS website, coalesce(source_url, chamber_url) AS scraped_from_url, nullif(phone, '') AS phone, email, industry, chamber_name FROM n WHERE name IS NOT NULL OR site IS NOT NULL")
def normalize_business(spark, sf_dir):
    """P1, F4."""
    n = resolve.identified(resolve.normalized(businesses(spark, sf_dir)))
    first = lambda c: F.get(c, F.lit(0))
    return n.select("seq", "company_name", "website", "scraped_from_url", first(F.col("phone_numbers")).alias("phone"), first(F.col("emails")).alias("email"), first(F.col("industry_tags")).alias("industry"), "chamber_name")


_HASH = "md5(lower(trim(coalesce(site, ''))) || '|' || lower(trim(coalesce(name, ''))))"


@query(_B + f" SELECT hash, min(seq) AS seq FROM (SELECT seq, {_HASH} AS hash FROM n WHERE name IS NOT NULL OR site IS NOT NULL) GROUP BY hash")
def dedupe_keep_first(spark, sf_dir):
    """J1, J2, W1."""
    return resolve.dedupe_by_hash(resolve.identified(resolve.normalized(businesses(spark, sf_dir)))).select("hash", "seq")


@query(_B + " SELECT chamber_url, min(seq) AS seq, count(*) AS n_seen FROM (SELECT *, lower(trim(coalesce(name, ''))) AS a, lower(trim(coalesce(website, ''))) AS w FROM b) WHERE a <> '' OR w <> '' GROUP BY chamber_url, a, w")
def dedupe_name_site(spark, sf_dir):
    """J5."""
    b = businesses(spark, sf_dir)
    kept = resolve.dedupe_by_name(b)
    key = lambda d: d.withColumn("k", F.concat_ws("|", resolve._key(F.col("name")), resolve._key(F.col("website"))))
    seen = key(b).groupBy("chamber_url", "k").agg(F.count("*").alias("n_seen"))
    return key(kept).join(seen, ["chamber_url", "k"]).select("chamber_url", "seq", "n_seen")


_LEADS = "s_suppkey AS id, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Firm ' || (s_suppkey * 2) END AS company_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'https://firm' || (s_suppkey * 4) || '.com' END AS website"


@query(_B + f""", l AS (SELECT {_LEADS} FROM supplier)
SELECT seq, least((SELECT min(id) FROM l WHERE l.website = n.site), (SELECT min(id) FROM l WHERE l.company_name = n.name)) AS lead_id FROM n WHERE name IS NOT NULL OR site IS NOT NULL""")
def match_existing_or(spark, sf_dir):
    """On website or name, without a nested loop."""
    incoming = resolve.identified(resolve.normalized(businesses(spark, sf_dir)))
    leads = table(spark, sf_dir, "supplier").selectExpr(*_split(_LEADS))
    return resolve.matches(incoming, leads).select("seq", "lead_id")


def _split(columns: str) -> list[str]:
    return [c.strip() for c in columns.split(", CASE")[:1]] + ["CASE" + c for c in columns.split(", CASE")[1:]]


def existing_leads(spark, sf_dir) -> DataFrame:
    base = table(spark, sf_dir, "supplier").selectExpr(*_split(_LEADS))
    empty = F.lit(None)
    return base.select(
        "id", "company_name", "website", F.lit("https://old.org").alias("scraped_from_url"), *[empty.cast("string").alias(c) for c in ("canonical_url", "description")],
        *[empty.cast("array<string>").alias(c) for c in ("phone_numbers", "emails", "addresses")], empty.cast("map<string,string>").alias("social_media_links"), empty.cast("array<string>").alias("industry_tags"),
        *[empty.cast("string").alias(c) for c in ("chamber_name", "chamber_url")], F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"),
    )


def upserted(spark, sf_dir) -> DataFrame:
    incoming = resolve.dedupe_by_hash(resolve.identified(resolve.normalized(businesses(spark, sf_dir))))
    return resolve.upsert(existing_leads(spark, sf_dir), incoming)


@query()
def upsert_leads(spark, sf_dir):
    """Records meet leads one after another. Tested against a sequential model."""
    return upserted(spark, sf_dir).select("id", "company_name", "website", F.concat_ws(",", "emails").alias("emails"), "chamber_name", "action")


_OWN = "CASE WHEN s_suppkey % 7 = 0 THEN 'Old ' || s_suppkey ELSE 'Firm ' || (s_suppkey * 3) END"
_APART = f"""
WITH l AS (SELECT s_suppkey AS id, {_OWN} AS company_name, CASE WHEN s_suppkey % 7 = 0 THEN 'https://old' || s_suppkey || '.com' ELSE 'https://firm' || (s_suppkey * 3) || '.com' END AS website FROM supplier),
c AS (SELECT c_custkey AS seq, 'Firm ' || c_custkey AS company_name, 'https://firm' || c_custkey || '.com' AS website, 'm' || c_custkey || '@firm.org' AS emails FROM customer),
u AS (SELECT id, l.company_name, l.website, coalesce(emails, '') AS emails, CASE WHEN seq IS NULL THEN 'keep' ELSE 'update' END AS action FROM l LEFT JOIN c USING (company_name)
UNION ALL SELECT (SELECT max(id) FROM l) + row_number() OVER (ORDER BY seq), company_name, website, emails, 'insert' FROM c WHERE company_name NOT IN (SELECT company_name FROM l))
"""


def upserted_apart(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """What comes in, and the leads after it, where every record meets one lead or none."""
    made = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS seq", "c_nationkey AS chamber_seq", "concat('Firm ', c_custkey) AS name", "concat('firm', c_custkey, '.com') AS website", "'' AS phone", "concat('m', c_custkey, '@firm.org') AS email",
        "CAST(NULL AS STRING) AS address", "c_mktsegment AS industry", "'https://chamber.org/list' AS source_url", "'Chamber' AS chamber_name", "'https://chamber.org' AS chamber_url",
    )
    number = "CASE WHEN id % 7 = 0 THEN concat('{0}', id) ELSE concat('{1}', id * 3) END"
    leads = existing_leads(spark, sf_dir).withColumns({"company_name": F.expr(number.format("Old ", "Firm ")), "website": F.concat(F.expr(number.format("https://old", "https://firm")), F.lit(".com"))})
    incoming = resolve.dedupe_by_hash(resolve.identified(resolve.normalized(made)))
    return made, resolve.upsert(leads, incoming)


@query(_APART + "SELECT * FROM u")
def upsert_apart(spark, sf_dir):
    """An upsert whose records do not meet one another."""
    return upserted_apart(spark, sf_dir)[1].select("id", "company_name", "website", F.concat_ws(",", "emails").alias("emails"), "action")


@query(_APART + "SELECT (SELECT count(*) FROM c) AS total_attempted, count(*) FILTER (action = 'insert') AS successful_inserts, count(*) FILTER (action = 'update') AS successful_updates, 0::BIGINT AS duplicates_skipped, 0::BIGINT AS errors FROM u")
def upsert_counters(spark, sf_dir):
    """What an upsert did."""
    made, after = upserted_apart(spark, sf_dir)
    done = resolve.counters(made, after, skipped=0, valid=made.count())
    return spark.createDataFrame([tuple(int(v) for v in done.values())], ", ".join(f"{k} BIGINT" for k in done))


@query("SELECT count(*) AS processed, count(*) FILTER (event_id % 3 = 0) AS saved, count(*) FILTER (event_id % 3 <> 0) AS failed FROM events")
def run_totals(spark, sf_dir):
    """Pages without an outcome count as failed."""
    return report.run_summary(table(spark, sf_dir, "events").selectExpr("CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS saved"))


@query("SELECT 1200::BIGINT AS total_processed, 4.0::DOUBLE AS elapsed_time_seconds, 300.0::DOUBLE AS processing_rate_per_second, count(DISTINCT c_nationkey)::BIGINT AS unique_hashes_tracked FROM customer")
def session_performance(spark, sf_dir):
    """A10."""
    return report.performance(1200, 4.0, table(spark, sf_dir, "customer").selectExpr("md5(cast(c_nationkey AS string)) AS hash"))


@query("SELECT 'https://c' || n_nationkey || '.org' AS chamber_url, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Unknown Chamber' END AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'https://own.org' ELSE 'https://c' || n_nationkey || '.org' END AS website, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END::BIGINT AS n_phones, 0::BIGINT AS n_emails FROM nation")
def chamber_records(spark, sf_dir):
    """P2."""
    made = table(spark, sf_dir, "nation").selectExpr(
        "concat('https://c', n_nationkey, '.org') AS url", "CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 2 THEN n_name WHEN 1 THEN '' END AS company_name", "CASE WHEN n_nationkey % 3 = 0 THEN 'https://own.org' END AS website",
        "CASE WHEN n_nationkey % 5 = 0 THEN array('+14155550123') END AS phone_numbers", "CAST(NULL AS array<string>) AS emails", "CAST(NULL AS array<string>) AS addresses", "'d' AS description", "CAST(NULL AS map<string,string>) AS social_media_links",
    )
    return directory.chamber_info(made).select("chamber_url", "name", "website", F.size("phone_numbers").cast("long").alias("n_phones"), F.size("emails").cast("long").alias("n_emails"))


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders")
def batch_assign(spark, sf_dir):
    """Chunks of 500 by a dense number that is made without one task seeing all rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return report.batches(report.dense_numbers(orders, "o_orderkey"), "number", 500).select("o_orderkey", "batch")


@query(f"SELECT DISTINCT link FROM (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS link, page_id FROM pages) a WHERE NOT EXISTS (SELECT 1 FROM pages b WHERE b.page_id % 7 = 0 AND regexp_extract(b.url, '^([a-z]+://[^/?#]*)', 1) = a.link)")
def visited_antijoin(spark, sf_dir):
    """F6, J7, U3."""
    links = table(spark, sf_dir, "pages").select("page_id", urls.site(F.col("url")).alias("link"))
    return directory.valid_links(links.select("link"), links.where("page_id % 7 = 0").select("link")).distinct()


# --- reports

_LEAD_ROWS = (
    "c_custkey AS id", "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END AS company_name", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'https://Site' || (c_custkey % 300) || '.com/x' END AS website",
    "CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE 'm' || c_custkey || '@a.org' END AS mail", "CASE WHEN c_custkey % 2 = 0 THEN '+1415555' || right('0000' || c_custkey, 4) END AS phone",
    "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS tag", "CASE WHEN c_custkey % 7 = 0 THEN 'Chamber ' || c_nationkey WHEN c_custkey % 7 = 1 THEN '' END AS chamber_name",
    "TIMESTAMP '2024-01-01 00:00:00' + (c_custkey % 50) * INTERVAL '1' DAY AS created_at",
)
_LR = f"WITH r AS (SELECT {', '.join(_LEAD_ROWS)} FROM customer)"


def leads(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "customer").selectExpr(*_LEAD_ROWS)
    some = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).when(F.col(c).isNotNull(), F.array(F.col(c)))
    return rows.select(
        "id", "company_name", "website", F.lit("https://seed.org").alias("scraped_from_url"), F.lit(None).cast("string").alias("canonical_url"), F.lit(None).cast("string").alias("description"),
        some("phone").alias("phone_numbers"), some("mail").alias("emails"), F.lit(None).cast("array<string>").alias("addresses"), F.when(F.col("phone").isNotNull(), F.create_map(F.lit("twitter"), F.concat(F.lit("https://x.com/u"), F.col("id")))).alias("social_media_links"),
        some("tag").alias("industry_tags"), "chamber_name", F.lit(None).cast("string").alias("chamber_url"), "created_at", F.col("created_at").alias("updated_at"),
    )


_PCT = lambda c: f"100.0::DOUBLE * {c} / count(*)"
_COUNTS = {"emails": "count(*) FILTER (mail <> '')", "phones": "count(phone)", "addresses": "0::BIGINT", "social": "count(phone)", "industry": "count(tag)", "chambers": "count(*) FILTER (chamber_name <> '')"}


@query(_LR + " SELECT count(*) AS total, " + ", ".join(f"{c} AS with_{k}, {_PCT(c)} AS {k}_pct" for k, c in _COUNTS.items()) + " FROM r")
def completeness_profile(spark, sf_dir):
    """A1, M4, M9."""
    return report.completeness(leads(spark, sf_dir))


@query(_LR + f""" SELECT count(*) AS total_leads, {_COUNTS['emails']} AS leads_with_emails, count(phone) AS leads_with_phones, count(website) AS leads_with_websites, count(DISTINCT regexp_extract(website, '://([^/]*)', 1)) AS unique_domains,
{_PCT(_COUNTS['emails'])} AS leads_with_emails_pct, {_PCT('count(phone)')} AS leads_with_phones_pct, {_PCT('count(website)')} AS leads_with_websites_pct, 120::BIGINT AS total_processed_this_session, 2.0::DOUBLE AS processing_rate_per_second, 60.0::DOUBLE AS elapsed_time_seconds FROM r""")
def db_statistics(spark, sf_dir):
    """A2, A3, T15."""
    return report.statistics(leads(spark, sf_dir), 120, 60.0)


@query(_LR + """ SELECT id, coalesce(nullif(company_name, ''), 'N/A') AS company, CASE WHEN chamber_name <> '' THEN 'Chamber' ELSE 'Website' END AS source, coalesce(tag, 'N/A') AS industry, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM r ORDER BY created_at DESC, id DESC LIMIT 5""")
def recent_leads(spark, sf_dir):
    """O1, O2, O3, P8, M10."""
    return report.recent(leads(spark, sf_dir), 5)


@query(_LR + """ SELECT id::VARCHAR AS id, company_name, coalesce(website, '') AS website, 'https://seed.org' AS scraped_from_url, '' AS canonical_url, '' AS description, coalesce(phone, '') AS phone_numbers, coalesce(mail, '') AS emails, '' AS addresses,
CASE WHEN phone IS NOT NULL THEN '{''twitter'': ''https://x.com/u' || id || '''}' ELSE '' END AS social_media_links, coalesce(tag, '') AS industry_tags, coalesce(chamber_name, '') AS chamber_name, '' AS chamber_url, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM r""")
def export_projection(spark, sf_dir):
    """K1, M1: every lead as it is exported."""
    return report.export_rows(leads(spark, sf_dir))


_RESULTS = "SELECT n_nationkey AS chamber_seq, n_nationkey % 4 <> 1 AS success, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_businesses FROM nation"


@query(f"WITH r AS ({_RESULTS}) SELECT count(*) AS attempted, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, coalesce(sum(n_businesses) FILTER (success), 0)::BIGINT AS businesses, coalesce(sum(greatest(1, n_businesses // 20)) FILTER (success), 0)::BIGINT AS pages, count(*) * (3600.0::DOUBLE / 1800.0) AS chambers_per_hour FROM r")
def chamber_summary(spark, sf_dir):
    """A6, A7, A8, F15, K6."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_businesses"))
    results = table(spark, sf_dir, "nation").join(n, "n_nationkey", "left").select((F.col("n_nationkey") % 4 != 1).alias("success"), F.coalesce("n_businesses", F.lit(0)).alias("n_businesses"))
    return report.batch_summary(results, 1800.0)


@query("SELECT count(*) AS chambers, sum(i)::BIGINT AS inserts, sum(u)::BIGINT AS updates, sum(e)::BIGINT AS errors FROM (SELECT c_nationkey, count(*) FILTER (c_custkey % 3 = 0) AS i, count(*) FILTER (c_custkey % 3 = 1) AS u, count(*) FILTER (c_custkey % 3 = 2) AS e FROM customer GROUP BY 1)")
def chamber_totals(spark, sf_dir):
    """A5, K5."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS chamber_url", "CASE c_custkey % 3 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' ELSE 'error' END AS action")
    return report.chamber_totals(report.action_counts(rows, ["chamber_url"]))


# --- directories

_ANSWER = """concat('```json\\n{"navigation_links":["/members"],"business_listings":[{"name":" ', p_name, ' ","website":"","phone":"', p_partkey, '","email":null,"address":"","industry":"', p_type, '"},{"name":"","website":"","phone":"1"}],"pagination":{"next_page_url":"/page/', p_partkey + 1, '","has_more":true}}\\n```')"""


@query("SELECT p_partkey, trim(p_name) AS name, p_partkey::VARCHAR AS phone, trim(p_type) AS industry, 'https://dir.org/page/' || p_partkey AS source_url FROM part WHERE p_partkey % 10 <> 0")
def listing_json_explode(spark, sf_dir):
    """Fenced answers; every tenth is no JSON."""
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('https://dir.org/page/', p_partkey) AS url", f"CASE WHEN p_partkey % 10 = 0 THEN 'no listing here' ELSE {_ANSWER} END AS answer")
    return directory.listings(pages).select("p_partkey", "name", "phone", "industry", "source_url")


@query("SELECT p_partkey, 'https://dir.org/page/' || (p_partkey + 1) AS next_url, 'https://dir.org/members' AS link FROM part")
def next_pages(spark, sf_dir):
    """L4, P6, T5."""
    pages = table(spark, sf_dir, "part").selectExpr("p_partkey", "concat('https://dir.org/page/', p_partkey) AS url", f"{_ANSWER} AS answer")
    return pages.select("p_partkey", directory.next_page(F.col("answer"), F.col("url")).alias("next_url"), F.get(directory.navigation_links(F.col("answer"), F.col("url")), F.lit(0)).alias("link"))


@query("""
WITH RECURSIVE walk(start, page, depth, seen) AS (
  SELECT n_nationkey, n_nationkey, 1, [n_nationkey] FROM nation UNION ALL
  SELECT start, (page * 7 + 3) % 25, depth + 1, list_append(seen, (page * 7 + 3) % 25) FROM walk WHERE depth < 50 AND page % 6 <> 5 AND NOT list_contains(seen, (page * 7 + 3) % 25))
SELECT 'p' || start AS start, 'p' || page AS page, depth::BIGINT AS depth FROM walk""")
def pagination_closure(spark, sf_dir):
    """Chains with ends and circles."""
    n = table(spark, sf_dir, "nation")
    links = n.selectExpr("concat('p', n_nationkey) AS url", "CASE WHEN n_nationkey % 6 <> 5 THEN concat('p', (n_nationkey * 7 + 3) % 25) END AS next_url")
    return directory.pagination(n.selectExpr("concat('p', n_nationkey) AS start"), links)


@query("SELECT 'https://chamber' || n_nationkey || '.org' AS chamber_url, unnest([CASE WHEN n_nationkey % 2 = 0 THEN 'https://chamber' || n_nationkey || '.org/list' ELSE 'https://chamber' || n_nationkey || '.org' || p END]) AS link FROM nation, (SELECT unnest(['/directory', '/members', '/business-directory', '/member-directory', '/businesses']) AS p) WHERE n_nationkey % 2 = 1 OR p = '/members'")
def fallback_links(spark, sf_dir):
    """P7."""
    n = table(spark, sf_dir, "nation").selectExpr("concat('https://chamber', n_nationkey, '.org') AS chamber_url", "CASE WHEN n_nationkey % 2 = 0 THEN array(concat('https://chamber', n_nationkey, '.org/list')) END AS links")
    return n.select("chamber_url", F.explode(directory.or_fallback(F.col("links"), F.col("chamber_url"))).alias("link"))


@query("""
SELECT 'https://chamber' || c_nationkey || '.org' AS chamber_url, (c_custkey % 3 + 1)::BIGINT AS page_no, c_name AS name, 'https://firm' || c_custkey || '.com' AS website, '415555' || right('0000' || c_custkey, 4) AS phone FROM customer""")
def directory_flow(spark, sf_dir):
    """Three linked pages of listings for each chamber, read by the rule-based extractor."""
    c = table(spark, sf_dir, "customer")
    card = F.expr("concat('<div class=\"listing\"><h3>', c_name, '</h3><a href=\"https://firm', c_custkey, '.com\">site</a><span class=\"phone\">415555', right(concat('0000', c_custkey), 4), '</span></div>')")
    pages = c.groupBy("c_nationkey", (F.col("c_custkey") % 3 + 1).cast("long").alias("no")).agg(F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    # a page that no customer is on would break a chain, so pages come from the nations
    all_ = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("no")).join(pages, ["c_nationkey", "no"], "left")
    site = F.concat(F.lit("https://chamber"), F.col("c_nationkey"), F.lit(".org"))
    onward = F.when(F.col("no") < 3, F.concat(F.lit('<a rel="next" href="/members/'), (F.col("no") + 1).cast("string"), F.lit('">more</a>'))).otherwise("")
    listed = all_.select(F.concat(site, F.lit("/members/"), F.col("no").cast("string")).alias("url"), F.concat(F.lit("<body>"), F.coalesce("cards", F.lit("")), onward, F.lit("</body>")).alias("html"))
    homes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey")).select(site.alias("url"), F.lit('<a href="/members/1">Member directory</a>').alias("html"))
    found = directory.parse_directories(homes.select(F.col("url").alias("chamber_url")), homes.unionByName(listed))
    return found.select("chamber_url", F.col("depth").alias("page_no"), "name", "website", "phone")


# --- fetching

_KIND = "CASE event_id % 8 WHEN 0 THEN 'invalid_url' WHEN 1 THEN 'robots' WHEN 2 THEN 'timeout' WHEN 3 THEN 'transport' WHEN 4 THEN 'browser' WHEN 5 THEN 'other' WHEN 6 THEN 'http' ELSE 'ok' END"


@query(f"SELECT event_id, (CASE event_id % 8 WHEN 0 THEN 0 WHEN 1 THEN 403 WHEN 2 THEN 408 WHEN 3 THEN 599 WHEN 4 THEN 598 WHEN 5 THEN 500 WHEN 6 THEN 404 ELSE 200 END)::INT AS status FROM events")
def fetch_status_map(spark, sf_dir):
    """C1."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", f"{_KIND} AS kind", "CASE event_id % 8 WHEN 6 THEN 404 ELSE 200 END AS code")
    return e.select("event_id", fetch.outcome(F.col("kind"), F.col("code")).alias("status"))


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 4 <> 0 AND 190 + event_id % 120 BETWEEN 200 AND 299")
def status_gate(spark, sf_dir):
    """F2."""
    pages = table(spark, sf_dir, "events").selectExpr("event_id", "CASE WHEN event_id % 4 <> 0 THEN 'x' ELSE '' END AS html", "190 + event_id % 120 AS status_code")
    return fetch.successful(pages).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def content_gate(spark, sf_dir):
    """F3."""
    r = table(spark, sf_dir, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE '' END AS company_name", "CASE WHEN c_custkey % 3 = 0 THEN array('a@b.c') END AS emails", "CASE WHEN c_custkey % 5 = 0 THEN array('1') ELSE cast(array() AS array<string>) END AS phone_numbers")
    return extract.worth_keeping(r).agg(F.count("*").alias("n"))


@query("SELECT r_regionkey, (k + 1)::INT AS attempt, power(2, k)::DOUBLE AS wait FROM region, (SELECT unnest(range(0, 5)) AS k) WHERE k < r_regionkey")
def retry_schedule(spark, sf_dir):
    """M13, C3."""
    r = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(fetch.retry_delays(F.col("r_regionkey"))).alias("k", "wait"))
    return r.select("r_regionkey", (F.col("k") + 1).alias("attempt"), "wait")


@query("SELECT r_regionkey, k::INT AS attempt, (2.0 * k)::DOUBLE AS wait FROM region, (SELECT unnest(range(1, 5)) AS k) WHERE k < r_regionkey")
def second_retry_waits(spark, sf_dir):
    """C5."""
    waits = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(fetch.linear_delays(F.col("r_regionkey"))).alias("k", "wait"))
    return waits.select("r_regionkey", (F.col("k") + 1).alias("attempt"), "wait")


@query("SELECT event_id, coalesce(sum((3 + event_id % 8)::DOUBLE) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS start FROM events")
def domain_schedule(spark, sf_dir):
    """W4, C4."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS domain", "event_id AS seq", "CAST(3 + event_id % 8 AS DOUBLE) AS delay")
    return fetch.schedule(e).select("event_id", "start")


@query(f"SELECT page_id, NOT (regexp_extract(url, '([^.]*\\.[^./?#]*)(?:[/?#]|$)', 1) = 'example.com' AND regexp_matches(url, '^[a-z]+://[^/]*/en/')) AS allowed FROM pages")
def robots_gate(spark, sf_dir):
    """F12, J9."""
    rules = spark.createDataFrame([("example.com", "User-agent: *\nDisallow: /en/\n"), ("example.net", ""), ("example.org", "User-agent: other\nDisallow: /\n")], "domain string, body string")
    return fetch.allowed(table(spark, sf_dir, "pages").select("page_id", "url"), rules, "loombot").select("page_id", "allowed")
