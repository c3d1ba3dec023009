"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad or not) are counted per host and shrunk level by
level: a public suffix's rate towards the rate of all labelled pages, a
registered domain's towards its suffix, a host's towards its domain. Each level
is a beta-binomial: the parent's posterior mean is the prior mean, and the
prior's strength is fitted over all groups of the level by moments. A host
without labelled pages has its domain's prior, and so on upwards. A host is
blocked only if the lower quantile of its posterior lies above the cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactloom.lexicons import LONG_SUFFIXES
from contactloom.llm.common import cut

#: host, path prefix, verdict
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Blocked if the rate of bad pages lies above CUT, but for a posterior probability of TAIL.
CUT, TAIL = 0.5, 0.05
#: The posterior's logit is integrated at STEPS places on either side of its mode, REACH standard deviations away at most.
STEPS, REACH = 600, 12.0
#: A posterior's parameters, at least.
LEAST = 0.01
#: Bounds of a prior's strength, in pages.
WEAK, STRONG = 1.0, 200.0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as written, and its verdict; null if none does."""
    name = verdict = None
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    for domain, prefix, said in longest:
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        text = domain + prefix
        name = F.when(fits, text) if name is None else name.when(fits, text)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (name, verdict) if longest else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def site_of(host: Column) -> Column:
    """A host without user, port and final dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$|\.:[0-9]*$", "")


def is_address(site: Column) -> Column:
    return F.regexp_like(site, F.lit(r"^[0-9]+(\.[0-9]+){3}$|^\["))


def suffix_of(site: Column) -> Column:
    """The public suffix: two labels if they are listed as one, else the last; of an address the whole."""
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), site).when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(site, ".", -1))


def domain_of(site: Column) -> Column:
    """The registered domain: the suffix and the label before it."""
    two = F.substring_index(site, ".", -2)
    return F.when(is_address(site), site).when(two.isin(*LONG_SUFFIXES), F.substring_index(site, ".", -3)).otherwise(two)


def _strength(groups: DataFrame) -> DataFrame:
    """The prior's strength of ``groups(n, k, mean)``, by moments; a single value.

    With m the prior mean of a group of n pages, k of them bad, (k - n m)^2 has
    the expectation n m (1 - m) (1 + (n - 1) rho), and the strength is 1 / rho - 1.
    """
    binomial = F.col("n") * F.col("mean") * (1 - F.col("mean"))
    found = groups.agg(F.sum((F.col("k") - F.col("n") * F.col("mean")) ** 2 - binomial).alias("over"), F.sum(binomial * (F.col("n") - 1)).alias("room"))
    rho = F.col("over") / F.nullif(F.col("room"), F.lit(0.0))
    fitted = F.when(rho > 0, F.greatest(F.lit(WEAK), F.least(F.lit(STRONG), 1 / rho - 1))).otherwise(F.lit(STRONG))
    return found.select(fitted.alias("strength"))


def _shrunk(groups: DataFrame) -> DataFrame:
    """``groups(n, k, mean)`` with the posterior's parameters a and b."""
    prior = F.col("strength") * F.col("mean")
    return groups.withColumn("strength", _strength(groups).scalar()).withColumns({"a": F.col("k") + prior, "b": F.col("n") - F.col("k") + F.col("strength") - prior}).drop("strength")


def reputation(outcomes: DataFrame) -> DataFrame:
    """``(host, n, k, a, b)`` for ``outcomes(host, bad)``: the posterior Beta(a, b) of every host's rate of bad pages.

    Null outcomes only name their host, null and empty hosts are left out.
    """
    known = outcomes.where("host is not null and host <> ''")
    hosts = cut(known.groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("k")))
    hosts = hosts.withColumn("site", site_of(F.col("host"))).select("host", "n", "k", domain_of(F.col("site")).alias("domain"), suffix_of(F.col("site")).alias("suffix"))
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    # a page more of either kind keeps the root off 0 and 1
    root = suffixes.agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("mean"))
    suffixes = cut(_shrunk(suffixes.withColumn("mean", root.scalar())))
    domains = cut(_shrunk(domains.join(suffixes.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), "suffix")))
    hosts = _shrunk(cut(hosts.drop("suffix").join(domains.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean")), "domain")))
    return hosts.select("host", "n", "k", "a", "b")


def lower_bound(a: Column, b: Column, tail: float = TAIL) -> Column:
    """The quantile ``tail`` of Beta(a, b).

    The density of the logit t is x^a (1 - x)^b, smooth for any parameters. It
    is summed on an even grid about its mode, and the quantile is interpolated.
    """
    a, b, h = F.greatest(a, F.lit(LEAST)), F.greatest(b, F.lit(LEAST)), REACH / STEPS
    mode, spread = F.log(a / b), F.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    # of log x, without overflow on either side
    log_x = lambda t: -(F.greatest(-t, F.lit(0.0)) + F.log(1 + F.exp(-F.abs(t))))
    log_density = lambda t: (a + b) * log_x(t) - b * t
    grid = F.transform(F.sequence(F.lit(-STEPS), F.lit(STEPS)), lambda i: F.exp(log_density(mode + spread * (i * h)) - log_density(mode)))
    start = F.struct(F.lit(-STEPS).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("last"), F.lit(None).cast("double").alias("u"))

    def quantile(weights: Column) -> Column:
        goal = F.aggregate(weights, F.lit(0.0), lambda n, w: n + w) * tail

        def step(s: Column, w: Column) -> Column:
            here = s["sum"] + w / 2
            u = F.when(s["u"].isNull() & (here >= goal), (s["i"] - (here - goal) / ((w + s["last"]) / 2)) * h).otherwise(s["u"])
            return F.struct((s["i"] + 1).alias("i"), (s["sum"] + w).alias("sum"), w.alias("last"), u.alias("u"))

        return F.aggregate(weights, start, step, lambda s: s["u"])

    u = F.get(F.transform(F.array(grid), quantile), F.lit(0))
    return 1 / (1 + F.exp(-F.greatest(mode + spread * u, F.lit(-700.0))))


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, cut: float = CUT, tail: float = TAIL) -> DataFrame:
    """Every row of ``pages(page_id, url)`` with host, path, rule, n_labelled, bad_bound and verdict.

    ``labels(doc_id, quality, toxic)`` are outcomes by page_id; a page is bad if
    its quality is 0 or it is toxic. Every host has a bound, without labelled
    pages that of its domain's prior; urls without a host have none and are
    allowed. Labels may repeat: each counts. A hot host meets a single row in
    the join, so its pages can be split freely.
    """
    slim = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = slim.select("page_id", "host").join(labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), "page_id", "left").select("host", "bad")
    known = reputation(outcomes).select(F.col("host").alias("known_host"), F.col("n").cast("long").alias("n_labelled"), F.round(lower_bound(F.col("a"), F.col("b"), tail), 6).alias("bad_bound"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    return slim.join(known, slim.host == known.known_host, "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(said, F.when(F.col("bad_bound") > cut, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("n_labelled", F.lit(0)).alias("n_labelled"), "bad_bound",
    )


SQL = r"""
WITH long_suffixes(two) AS (VALUES LONG_SUFFIXES),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
o AS (
  SELECT host, count(*) FILTER (quality IS NOT NULL OR toxic IS NOT NULL)::DOUBLE AS n, count(*) FILTER (quality = 0 OR toxic = 1)::DOUBLE AS k,
         regexp_replace(host, '^.*@|:[0-9]*$|\.$|\.:[0-9]*$', '', 'g') AS site
  FROM p LEFT JOIN labels ON doc_id = page_id WHERE host <> '' GROUP BY host),
l AS (SELECT *, regexp_matches(site, '^[0-9]+(\.[0-9]+){3}$|^\[') AS address, regexp_extract(site, '([^.]*\.)?[^.]*$') AS last_two FROM o),
h AS (
  SELECT host, n, k,
         CASE WHEN address THEN site WHEN two IS NOT NULL THEN regexp_extract(site, '([^.]*\.)?[^.]*\.[^.]*$') ELSE last_two END AS domain,
         CASE WHEN address THEN site WHEN two IS NOT NULL THEN two ELSE regexp_extract(site, '[^.]*$') END AS suffix
  FROM l LEFT JOIN long_suffixes ON two = last_two),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
s1 AS (SELECT *, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM s) AS m FROM s),
sr AS (SELECT sum(power(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0) AS rho FROM s1),
s2 AS (SELECT suffix, CASE WHEN rho > 0 THEN greatest(1.0, least(200.0, 1 / rho - 1)) ELSE 200.0 END AS g, (k + g * m) / (n + g) AS mean FROM s1, sr),
d1 AS (SELECT d.*, mean AS m FROM d JOIN s2 USING (suffix)),
dr AS (SELECT sum(power(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0) AS rho FROM d1),
d2 AS (SELECT domain, CASE WHEN rho > 0 THEN greatest(1.0, least(200.0, 1 / rho - 1)) ELSE 200.0 END AS g, (k + g * m) / (n + g) AS mean FROM d1, dr),
h1 AS (SELECT h.*, mean AS m FROM h JOIN d2 USING (domain)),
hr AS (SELECT sum(power(k - n * m, 2) - n * m * (1 - m)) / nullif(sum(n * m * (1 - m) * (n - 1)), 0) AS rho FROM h1),
h2 AS (SELECT host, n, CASE WHEN rho > 0 THEN greatest(1.0, least(200.0, 1 / rho - 1)) ELSE 200.0 END AS g, greatest(k + g * m, 0.01) AS a, greatest(n - k + g - g * m, 0.01) AS b FROM h1, hr),
q1 AS (SELECT host, a, b, ln(a / b) AS mode, sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b)) AS spread, unnest(range(-600, 601)) AS i FROM h2),
q2 AS (SELECT host, i, mode, spread, mode + spread * (i * 0.02) AS t, (a + b) * -(greatest(-t, 0.0) + ln(1 + exp(-abs(t)))) - b * t AS d, (a + b) * -(greatest(-mode, 0.0) + ln(1 + exp(-abs(mode)))) - b * mode AS top FROM q1),
q3 AS (SELECT host, i, mode, spread, exp(d - top) AS w, sum(exp(d - top)) OVER (PARTITION BY host ORDER BY i) - exp(d - top) / 2 AS here FROM q2),
q4 AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY host ORDER BY i), 0) AS prior, 0.05 * sum(w) OVER (PARTITION BY host) AS goal FROM q3),
q5 AS (SELECT host, min_by(mode + spread * ((i - (here - goal) / ((w + prior) / 2)) * 0.02), i) AS t FROM q4 WHERE here >= goal GROUP BY host),
h3 AS (SELECT host, n, round(1 / (1 + exp(-greatest(t, -700.0))), 6) AS bad_bound FROM h2 JOIN q5 USING (host)),
r(domain, prefix, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (
  SELECT p.host, p.path, max_by(domain || prefix, length(domain || prefix)) AS rule, max_by(verdict, length(domain || prefix)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) p JOIN r ON (p.host = domain OR ends_with(p.host, '.' || domain)) AND starts_with(p.path, prefix) GROUP BY ALL)
SELECT page_id, p.host, p.path, rule, coalesce(u.verdict, CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(h3.n, 0)::BIGINT AS n_labelled, bad_bound
FROM p LEFT JOIN h3 USING (host) LEFT JOIN u ON u.host = p.host AND u.path = p.path
""".replace("LONG_SUFFIXES", ", ".join(f"('{x}')" for x in LONG_SUFFIXES))
