import math
import random
import re

import pytest
from pyspark.sql import functions as F

from contactloom.lexicons import LONG_SUFFIXES
from contactloom.llm import queries, url_reputation
from tests.llm import plain


def parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (plain.lower(m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fit = [(d + p, v) for d, p, v in url_reputation.RULES if (host == d or host.endswith("." + d)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def strength(groups):
    over = sum((k - n * m) ** 2 - n * m * (1 - m) for n, k, m in groups)
    room = sum(n * m * (1 - m) * (n - 1) for n, k, m in groups)
    rho = over / room if room else 0
    return max(1.0, min(200.0, 1 / rho - 1)) if rho > 0 else 200.0


def levels(host):
    """Registered domain and suffix."""
    site = re.sub(r"\.$", "", re.sub(r":[0-9]*$", "", host.rpartition("@")[2]))
    labels = site.split(".")
    if site.startswith("[") or len(labels) == 4 and all(x.isdigit() for x in labels):
        return site, site
    n = 2 if ".".join(labels[-2:]) in LONG_SUFFIXES else 1
    return ".".join(labels[-n - 1 :]), ".".join(labels[-n:])


def beta_share(x, a, b):
    """The share of Beta(a, b) below x, by the continued fraction."""
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for odd in (0, 1):
            k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) if odd else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            d, c = 1 / (1 + k * d), 1 + k / c
            f *= c * d
    return front * f


def quantile(p, a, b):
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_share(mid, a, b) < p else (low, mid)
    return low


def bounds(outcomes):
    """The lower bound of every host, level by level."""
    count = {}
    for host, bad in outcomes:
        if host:
            n, k = count.get(host, (0, 0))
            count[host] = n + (bad is not None), k + (bad or 0)

    def up(key):
        out = {}
        for g, (n, k) in count.items():
            a, b = out.get(key(g), (0, 0))
            out[key(g)] = a + n, b + k
        return out

    root = {"": (sum(k for _, k in count.values()) + 1) / (sum(n for n, _ in count.values()) + 2)}
    suffixes, domains = up(lambda h: levels(h)[1]), up(lambda h: levels(h))
    m = {g: root[""] for g in suffixes}
    s = strength([(n, k, m[g]) for g, (n, k) in suffixes.items()])
    of_suffix = {g: (k + s * m[g]) / (n + s) for g, (n, k) in suffixes.items()}
    s = strength([(n, k, of_suffix[g[1]]) for g, (n, k) in domains.items()])
    of_domain = {g: (k + s * of_suffix[g[1]]) / (n + s) for g, (n, k) in domains.items()}
    s = strength([(n, k, of_domain[levels(h)]) for h, (n, k) in count.items()])
    return {h: (n, quantile(url_reputation.TAIL, k + s * of_domain[levels(h)], n - k + s * (1 - of_domain[levels(h)]))) for h, (n, k) in count.items()}


def fixture():
    rng = random.Random(4)
    hosts = ["bad.evil.biz", "worse.evil.biz", "fine.shop.biz", "a.org", "b.a.org", "localhost", "x.io", "Mixed.Case.IO"]
    share = dict(zip(hosts, (0.95, 0.9, 0.05, 0.3, 0.0, 1.0, 0.5, 0.2)))
    urls, labels = [], []
    for k in range(600):
        h = hosts[min(int(rng.expovariate(0.5)), 7)]
        urls.append(f"http://{h}/p/{k}?q#f")
        if rng.random() < 0.7:
            bad = rng.random() < share[h]
            labels.append((k, None if k % 50 == 0 else int(not bad), int(bad) if k % 3 == 0 else None))
    odd = [None, "", "no scheme", "://", "http://", "https://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://a.www.example.com/en/x", "http://example.com", "http://b.net/es/1", "http://net/fr/", "http://notexample.com/en/", "http://x.com?y=/z", "http://u\nv.net/es/\n", "a://b.biz://c.net/es/"]
    return urls + odd, labels + labels[:20] + [(99_999, 0, 1), (None, 0, 0), (5, None, None)]


def test_against_plain(spark):
    urls, labels = fixture()
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(urls)] + [(0, urls[0], "x", "y"), (None, urls[1], "x", "y")], "page_id long, url string, host string, verdict string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    pairs = [*enumerate(urls), (0, urls[0]), (None, urls[1])]
    outcomes = [(parts(u)[0], None) for _, u in pairs]
    for i, u in pairs:
        outcomes += [(parts(u)[0], None if q is None and t is None else int(q == 0 or t == 1)) for d, q, t in labels if d == i and d is not None]
    known, want = bounds(outcomes), []
    for i, u in pairs:
        host, path = parts(u)
        name, said = rule(host, path)
        n, bound = known.get(host, (0, None))
        want.append((i, host, path, name, said or ("block" if bound is not None and bound > url_reputation.CUT else "allow"), n, bound))
    got = url_reputation.judge(pages, table)
    rounded = lambda rows: sorted((repr((*r[:6], None if r[6] is None else round(r[6], 3))) for r in rows))
    assert rounded(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "bad_bound").collect()) == rounded(want)
    verdicts = {w[1]: w[4] for w in want if w[3] is None}
    assert verdicts["bad.evil.biz"] == "block" and verdicts["fine.shop.biz"] == "allow" == verdicts[""]


def test_domains_and_suffixes(spark):
    hosts = {"shop.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "192.168.1.5": ("192.168.1.5",) * 2, "u:p@a.b.com:8080": ("b.com", "com"), "a.b.org.": ("b.org", "org"), "localhost:80": ("localhost",) * 2, "[::1]:443": ("[::1]",) * 2}
    site = url_reputation.site_of(F.col("h"))
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", url_reputation.domain_of(site), url_reputation.suffix_of(site)).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == hosts and all(levels(h) == want for h, want in hosts.items())


def test_quantiles(spark):
    cases = [(1.0, 1.0), (0.5, 0.5), (3.0, 0.2), (0.5, 40.0), (40.0, 2.5), (2000.0, 1000.0), (1e6, 3e6)]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", url_reputation.lower_bound(F.col("a"), F.col("b")).alias("q")).collect()
    for r in got:
        assert abs(r.q - (quantile(0.05, r.a, r.b) if r.a < 1e5 else 0.25 - 1.64485 * (0.25 * 0.75 / 4e6) ** 0.5)) < 5e-4, r


def test_a_new_host_of_a_bad_domain(spark):
    """Without labelled pages of its own a host has the prior that its domain gives it."""
    seen = [(k, f"http://h{k % 20}.evil.biz/{k}") for k in range(400)] + [(400 + k, f"http://h{k % 20}.shop.org/{k}") for k in range(400)]
    pages = spark.createDataFrame([*seen, (900, "http://new.evil.biz/"), (901, "http://new.shop.org/"), (902, "http://fresh.net/")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(k < 400)) for k in range(800)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.n_labelled) for r in url_reputation.judge(pages, labels).where("page_id >= 900").collect()}
    assert got == {900: ("block", 0), 901: ("allow", 0), 902: ("allow", 0)}


def test_shrinking(spark):
    """One bad page convicts no host of a clean domain, and a new host of a bad domain is nearer to conviction."""
    rows = [("a.good.biz", 0)] * 40 + [("b.good.biz", 1)] + [("a.evil.biz", 1)] * 40 + [("b.evil.biz", 1)] + [("c.mixed.io", k % 2) for k in range(40)]
    got = {r.host: r.a / (r.a + r.b) for r in url_reputation.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.good.biz"] < got["b.good.biz"] < 0.5 < got["b.evil.biz"] <= got["a.evil.biz"] + 0.05


def test_empty_tables(spark):
    urls, labels = fixture()
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert url_reputation.judge(pages.limit(0), table).count() == 0
    assert url_reputation.judge(pages, table.limit(0)).where(F.col("rule").isNull() & (F.col("verdict") != "allow")).count() == 0


def test_no_python_in_the_plan(spark):
    urls, labels = fixture()
    plan = url_reputation.judge(spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query_against_sql(spark):
    got, want = plain.against_sql(spark, queries.op5_url_reputation, url_reputation.SQL)
    assert got == want
