"""Fetch outcomes, robots rules, retries and request spacing."""

from __future__ import annotations

from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactloom.functions import urls
from contactloom.functions.text import captcha, filled

INVALID_URL, ROBOTS_DENIED, TIMED_OUT, NO_TRANSPORT, NO_BROWSER, OTHER = 0, 403, 408, 599, 598, 500
FAILURES = {"invalid_url": INVALID_URL, "robots": ROBOTS_DENIED, "timeout": TIMED_OUT, "transport": NO_TRANSPORT, "browser": NO_BROWSER}


def outcome(kind: Column, status: Column) -> Column:
    """The status a fetch reports: that of the response, or the code of its kind of failure."""
    found = F.when(kind.isin("ok", "http"), status)
    for name, code in FAILURES.items():
        found = found.when(kind == name, F.lit(code))
    return found.otherwise(F.lit(OTHER)).cast("int")


def successful(pages: DataFrame) -> DataFrame:
    """Pages with html and a status from 200 to 299."""
    return pages.where(filled(F.col("html")) & F.col("status_code").between(200, 299))


def flagged(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``captcha``: they are kept, only marked."""
    return pages.withColumn("captcha", captcha(F.col(html)))


def allowed(targets: DataFrame, robots: DataFrame, agent: str, url: str = "url") -> DataFrame:
    """``targets`` with ``allowed`` by ``robots(domain, body)``; no rules, no domain and broken rules allow."""
    rules = robots.groupBy("domain").agg(F.min("body").alias("body_"))
    joined = targets.withColumn("domain_", urls.registered_domain(F.col(url))).join(rules, F.col("domain_") == F.col("domain"), "left").drop("domain")

    def run(bodies: pd.Series, addresses: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser | None] = {}

        def may(body, address) -> bool:
            if not body:
                return True
            if body not in parsers:
                if len(parsers) > 1000:
                    parsers.clear()
                try:
                    parsers[body] = RobotFileParser()
                    parsers[body].parse(body.splitlines())
                except Exception:
                    parsers[body] = None
            try:
                return parsers[body] is None or parsers[body].can_fetch(agent, address or "")
            except Exception:
                return True

        return pd.Series([may(b, a) for b, a in zip(bodies, addresses)], dtype=bool)

    run.__annotations__ = {"bodies": pd.Series, "addresses": pd.Series, "return": pd.Series}
    return joined.withColumn("allowed", F.pandas_udf(run, "boolean")(F.col("body_"), F.col(url))).drop("domain_", "body_")


def retry_delays(max_retries: Column, first: float = 1.0, factor: float = 2.0) -> Column:
    """Waits before each retry, without jitter: first, first * factor, ..."""
    steps = F.when(max_retries > 0, F.sequence(F.lit(0), max_retries.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.lit(first) * F.pow(F.lit(factor), k))


def linear_delays(tries: Column, step: float = 2.0) -> Column:
    """Waits between tries that grow by a step each time: step, 2 step, ..."""
    steps = F.when(tries > 1, F.sequence(F.lit(1), tries.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.lit(step) * k)


def jittered(delay: Column, jitter: float = 0.5, seed: int = 0) -> Column:
    return delay * (1 - jitter + 2 * jitter * F.rand(seed))


def schedule(requests: DataFrame, by: str = "domain", order: str = "seq", delay: str = "delay") -> DataFrame:
    """``requests`` with ``start``: seconds after the first request of the domain, each waiting for those before it.

    Spacing within a domain is a chain, so a domain is one task's; domains are
    spread. The number of requests to a domain is what a crawl can send it.
    """
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return requests.withColumn("start", F.coalesce(F.sum(delay).over(w), F.lit(0.0)))
