"""Business directories: link discovery, answers of an extractor, pagination, and the whole flow."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.functions import urls
from contactloom.functions.text import filled
from contactloom.operators.resolve import dedupe_by_name
from contactloom.schemas import ANSWER_DDL, LISTING_FIELDS
from contactloom.session import cut

#: Tried on a site where no directory link is found.
FALLBACK_PATHS = ("/directory", "/members", "/business-directory", "/member-directory", "/businesses")
MAX_PAGES, PAGES_PER_LISTINGS, CHAMBERS_PER_BATCH = 50, 20, 5
LINK_WORDS = r"(?i)\b(members?|director(?:y|ies)|business(?:es)?|companies|listings?)\b"


class ListingExtractor(Protocol):
    """What answers for a directory page: JSON of the answer's form. A model, or the rules below."""

    def __call__(self, url: str, html: str) -> str: ...


def unfenced(c: Column) -> Column:
    """A raw answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def parsed_answer(c: Column) -> Column:
    """An answer as a struct; null if it is no JSON. A last attempt closes what a cut-off answer left open."""
    text = unfenced(c)
    read = lambda x: F.from_json(x, ANSWER_DDL, {"mode": "PERMISSIVE"})
    fine = F.try_parse_json(text).isNotNull()
    # the last whole listing of a list that was cut off
    mended = F.concat(F.regexp_extract(text, r'(?s)^(.*"business_listings"\s*:\s*\[.*\})', 1), F.lit("]}"))
    return F.when(fine, read(text)).when(F.try_parse_json(mended).isNotNull() & (F.length(mended) > 2), read(mended))


def listings(pages: DataFrame, answer: str = "answer", url: str = "url") -> DataFrame:
    """A row for each listing with a name or a website: six stripped fields, empty ones null, and source_url.

    Explicit nulls are nulls. Other columns of ``pages`` stay.
    """
    stripped = lambda x, f: F.nullif(F.regexp_replace(x[f], r"(?U)^\s+|\s+$", ""), F.lit(""))
    cleaned = F.transform(parsed_answer(F.col(answer))["business_listings"], lambda x: F.struct(*[stripped(x, f).alias(f) for f in LISTING_FIELDS]))
    rows = pages.select(*[c for c in pages.columns if c != answer], F.posexplode(cleaned).alias("pos", "b_"))
    kept = rows.where(filled(F.col("b_.name")) | filled(F.col("b_.website")))
    return kept.select(*[c for c in rows.columns if c != "b_"], *[F.col(f"b_.{f}").alias(f) for f in LISTING_FIELDS], F.col(url).alias("source_url"))


def next_page(answer: Column, url: Column) -> Column:
    """The absolute url of the next page, or null."""
    return urls.absolute(url, parsed_answer(answer)["pagination"]["next_page_url"])


def navigation_links(answer: Column, url: Column) -> Column:
    """Absolute links of an answer: those with http as they are, others joined to the page."""
    links = F.filter(parsed_answer(answer)["navigation_links"], lambda x: filled(x))
    return F.transform(links, lambda x: F.when(F.startswith(x, F.lit("http")), x).otherwise(urls.absolute(url, x, general=False)))


def valid_links(links: DataFrame, visited: DataFrame | None = None, column: str = "link") -> DataFrame:
    """Links with scheme and host that were not visited before."""
    fine = links.where(urls.authority(F.col(column)).isNotNull())
    return fine if visited is None else fine.join(visited.select(F.col(visited.columns[0]).alias(column)).distinct(), column, "left_anti").select(links.columns)


def or_fallback(links: Column, url: Column) -> Column:
    """The links found, or the usual paths of the site if there are none."""
    usual = F.array(*[F.concat(urls.site(url), F.lit(p)) for p in FALLBACK_PATHS])
    return F.when(F.coalesce(F.size(links), F.lit(0)) > 0, links).otherwise(usual)


def chamber_info(c: DataFrame, url: str = "url") -> DataFrame:
    """A chamber's record with its defaults: the name, the website, empty lists."""
    empty = F.array().cast("array<string>")
    return c.select(
        F.col(url).alias("chamber_url"), F.coalesce(F.nullif("company_name", F.lit("")), F.lit("Unknown Chamber")).alias("name"), F.coalesce("website", F.col(url)).alias("website"),
        *[F.coalesce(x, empty).alias(x) for x in ("phone_numbers", "emails", "addresses")], "description", "social_media_links", F.col(url).alias("scraped_from_url"),
    )


def pagination(starts: DataFrame, links: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """``(start, page, depth)`` for ``starts(start)`` and ``links(url, next_url)``, from depth 1.

    A chain ends at a page without a next one, at one that it had before, or
    after ``max_pages``. Each step is a join of the chains' ends with the links.
    """
    spark = starts.sparkSession
    starts.select("start").distinct().createOrReplaceTempView("loom_starts")
    links.where("next_url is not null").groupBy("url").agg(F.min("next_url").alias("next_url")).createOrReplaceTempView("loom_links")
    return spark.sql(f"""
        WITH RECURSIVE walk(start, page, depth, seen) MAX RECURSION LEVEL {max_pages + 1} AS (
          SELECT start, start, 1, array(start) FROM loom_starts
          UNION ALL
          SELECT start, next_url, depth + 1, array_append(seen, next_url)
          FROM walk JOIN loom_links ON page = url
          WHERE depth < {max_pages} AND NOT array_contains(seen, next_url))
        SELECT start, page, CAST(depth AS BIGINT) AS depth FROM walk""")


def visited_once(walks: DataFrame) -> DataFrame:
    """Pages of all walks, each in the first walk that comes to it (by start), as a shared set of visited pages gives."""
    return walks.groupBy("page").agg(F.min_by(F.struct("start", "depth"), F.struct("start", "depth")).alias("w")).select("w.start", "page", "w.depth")


def rule_based(url: str, html: str) -> str:
    """A listing extractor without a model: elements whose class speaks of a listing, and links that speak of a directory."""
    import json
    import re
    from urllib.parse import urljoin

    from contactloom.functions.dom import Tree, below, text_of

    tree = Tree(html or "")
    found = []
    for e in tree.all:
        if not re.search(r"\b(listing|member|business)(-(card|item|entry))?\b", e.attrs.get("class", "")):
            continue
        own = below(e, tree)
        if any(re.search(r"\b(listing|member|business)(-(card|item|entry))?\b", x.attrs.get("class", "")) for x in own):
            continue
        by_class = lambda *names: next((text_of(x) for x in own if any(n in x.attrs.get("class", "") for n in names)), None)  # noqa: B023, E731
        links = [x.attrs["href"] for x in own if x.tag == "a" and x.attrs.get("href")]
        name = by_class("name", "title") or next((text_of(x) for x in own if x.tag in ("h2", "h3", "h4", "strong")), None)
        found.append({
            "name": name, "website": next((h for h in links if h.startswith("http")), None), "phone": by_class("phone", "tel") or next((h[4:] for h in links if h.startswith("tel:")), None),
            "email": next((h[7:].split("?")[0] for h in links if h.startswith("mailto:")), None), "address": by_class("addr") or next((text_of(x) for x in own if x.tag == "address"), None), "industry": by_class("categor", "industry"),
        })
    anchors = [(x.attrs["href"], text_of(x) or "") for x in tree.all if x.tag == "a" and x.attrs.get("href")]
    onward = next((urljoin(url, x.attrs["href"]) for x in tree.all if x.tag in ("a", "link") and x.attrs.get("href") and ("next" in x.attrs.get("rel", "").split() or re.fullmatch(r"(?i)next( page)?\s*[›»>]*", text_of(x) or ""))), None)
    navigation = list(dict.fromkeys(urljoin(url, h) for h, t in anchors if re.search(LINK_WORDS, t) or re.search(LINK_WORDS, h.replace("/", " ").replace("-", " "))))
    return json.dumps({"navigation_links": navigation, "business_listings": found, "pagination": {"next_page_url": onward, "has_more": onward is not None}})


def answers(pages: DataFrame, extractor: ListingExtractor = rule_based, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the extractor's answer; an error gives an empty answer."""

    def run(addresses: pd.Series, texts: pd.Series) -> pd.Series:
        def one(u, h):
            try:
                return extractor(u, h)
            except Exception:
                return None

        return pd.Series([one(u, h) for u, h in zip(addresses, texts)], dtype=object)

    run.__annotations__ = {"addresses": pd.Series, "texts": pd.Series, "return": pd.Series}
    return pages.withColumn("answer", F.pandas_udf(run, "string")(F.col(url), F.col(html)))


def parse_directories(chambers: DataFrame, pages: DataFrame, extractor: ListingExtractor = rule_based, max_pages: int = MAX_PAGES) -> DataFrame:
    """Listings of ``chambers(chamber_url)`` over fetched ``pages(url, html)``, without repeats within a chamber.

    A chamber's page names its directories, or the usual paths stand in; each
    directory is followed page by page; listings keep the order of directory,
    page and place.
    """
    # the extractor is the costly step: its answers are kept, as every step of the walk would ask for them again
    answered = cut(answers(pages.select("url", "html"), extractor))
    home = chambers.join(answered, chambers.chamber_url == answered.url).select("chamber_url", or_fallback(navigation_links(F.col("answer"), F.col("url")), F.col("url")).alias("links"))
    directories = home.select("chamber_url", F.posexplode("links").alias("dir_no", "start"))
    links = cut(answered.select("url", next_page(F.col("answer"), F.col("url")).alias("next_url")))
    walks = pagination(directories, links, max_pages)
    placed = directories.join(walks, "start").groupBy("page").agg(F.min(F.struct("chamber_url", "dir_no", "depth")).alias("w")).select("page", "w.*")
    rows = listings(placed.join(answered, placed.page == answered.url).select("chamber_url", "dir_no", "depth", "url", "answer"))
    ordered = rows.withColumn("seq", F.struct("dir_no", "depth", "pos"))
    return dedupe_by_name(ordered, "seq", "chamber_url").select("chamber_url", "seq.*", *LISTING_FIELDS, "source_url")
