"""Fetched pages and robots rules as DataFrames."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.config import CrawlerSettings
from contactloom.functions.urls import fetchable, registered_domain
from contactloom.operators.fetch import INVALID_URL, NO_BROWSER, NO_TRANSPORT, OTHER, TIMED_OUT, allowed

PAGE_DDL = "url STRING, html STRING, status_code INT, final_url STRING"
#: fetches one url within a time: (html, status, final url); a browser-backed one fits as well
Fetcher = Callable[[str, dict, float], tuple[str | None, int, str]]


def http_get(url: str, headers: dict, timeout: float) -> tuple[str | None, int, str]:
    """A page by HTTP; redirects are followed; what fails gives the code of its kind."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status, r.url
    except urllib.error.HTTPError as e:
        return None, e.code, url
    except TimeoutError:
        return None, TIMED_OUT, url
    except urllib.error.URLError as e:
        return None, TIMED_OUT if isinstance(e.reason, TimeoutError) else NO_TRANSPORT, url
    except Exception:
        return None, OTHER, url


def rendered(render: Callable[[str, float], tuple[str | None, int, str]]) -> Fetcher:
    """A fetcher by a browser: ``render(url, timeout)`` gives html, status and final url once the page's content is there.

    It gets twice the time of a plain fetch; what it raises counts as the browser's failure.
    """

    def run(url: str, headers: dict, timeout: float) -> tuple[str | None, int, str]:
        try:
            return render(url, 2 * timeout)
        except Exception:
            return None, NO_BROWSER, url

    return run


def insistent(fetcher: Fetcher, tries: int = 3, step: float = 2.0, sleep=time.sleep) -> Fetcher:
    """A fetcher that tries until a page has content and a status of success, ``tries`` times at most, waiting ``step`` seconds longer each time."""

    def run(url: str, headers: dict, timeout: float) -> tuple[str | None, int, str]:
        for k in range(1, tries + 1):
            found = fetcher(url, headers, timeout)
            if found[0] and 200 <= found[1] < 300 or k == tries:
                return found
            sleep(step * k)
        return found

    return run


def retried(fetcher: Fetcher, settings: CrawlerSettings, sleep=time.sleep, rng: random.Random | None = None) -> Fetcher:
    """A fetcher that tries again after passing failures, waiting longer each time, with jitter."""
    rng = rng or random.Random()

    def run(url: str, headers: dict, timeout: float) -> tuple[str | None, int, str]:
        delay = settings.first_delay
        for k in range(settings.max_retries + 1):
            found = fetcher(url, headers, timeout)
            if found[1] not in (TIMED_OUT, NO_TRANSPORT, OTHER, 429, 502, 503, 504) or k == settings.max_retries:
                return found
            sleep(delay * rng.uniform(0.5, 1.5))
            delay *= settings.backoff
        return found

    return run


def fetch(urls: DataFrame, settings: CrawlerSettings | None = None, fetcher: Fetcher = http_get, robots: DataFrame | None = None, sleep=time.sleep) -> DataFrame:
    """``urls(url)`` fetched, as PAGE_DDL. Urls that are none get status 0, those the rules deny 403.

    A domain's urls meet in one task, which keeps the pause between them.
    """
    settings = settings or CrawlerSettings()
    targets = urls.select("url").withColumn("domain", registered_domain(F.col("url")))
    ok = targets.where(fetchable(F.col("url")))
    bad = targets.where(~fetchable(F.col("url")) | F.col("url").isNull()).select("url", F.lit(None).cast("string").alias("html"), F.lit(INVALID_URL).alias("status_code"), F.col("url").alias("final_url"))
    denied = None
    if robots is not None and settings.respect_robots:
        judged = allowed(ok.drop("domain"), robots, settings.user_agent).withColumn("domain", registered_domain(F.col("url")))
        denied = judged.where("not allowed").select("url", F.lit(None).cast("string").alias("html"), F.lit(403).alias("status_code"), F.col("url").alias("final_url"))
        ok = judged.where("allowed").drop("allowed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, last = retried(fetcher, settings, sleep), {}
        for batch in batches:
            rows = []
            for url, domain in zip(batch["url"], batch["domain"]):
                gap = random.uniform(settings.min_delay_per_domain, settings.max_delay_per_domain)
                if domain in last and (wait := last[domain] + gap - time.monotonic()) > 0:
                    sleep(wait)
                rows.append((url, *get(url, {"User-Agent": settings.user_agent}, settings.timeout_seconds)))
                last[domain] = time.monotonic()
            yield pd.DataFrame(rows, columns=["url", "html", "status_code", "final_url"])

    out = ok.repartition("domain").mapInPandas(run, PAGE_DDL).unionByName(bad)
    return out if denied is None else out.unionByName(denied)


def robots_rules(domains: DataFrame, fetcher: Fetcher = http_get, timeout: float = 10.0, agent: str = "contactloom/1.0") -> DataFrame:
    """``(domain, body)`` of ``domains(domain)``: by https, then http; anything but 200 gives null, which allows all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d in batch["domain"]:
                body = None
                for scheme in ("https", "http"):
                    html, status, _ = fetcher(f"{scheme}://{d}/robots.txt", {"User-Agent": agent}, timeout)
                    if status == 200:
                        body = html or ""
                        break
                rows.append((d, body))
            yield pd.DataFrame(rows, columns=["domain", "body"])

    return domains.select("domain").where("domain is not null").distinct().mapInPandas(run, "domain STRING, body STRING")
