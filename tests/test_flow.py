import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from contactloom import cli, config
from contactloom.operators import directory, fetch, report
from contactloom.sources import pages, seeds
from contactloom.sources.leads import Leads, export_csv, save_results


def test_settings(tmp_path):
    assert config.load(env={}).crawler.max_retries == 3
    got = config.load(env={"CRAWLER__MAX_RETRIES": "5", "PROFILE": "extended", "STORE_BATCH_SIZE": "7"})
    assert (got.crawler.max_retries, got.profile, got.store.batch_size) == (5, "extended", 7)
    (tmp_path / ".env").write_text("# x\nCRAWLER__RESPECT_ROBOTS=false\nCRAWLER__MAX_RETRIES=2\n")
    got = config.load(env={"CRAWLER__MAX_RETRIES": "4"}, env_file=tmp_path / ".env")
    assert (got.crawler.respect_robots, got.crawler.max_retries) == (False, 4)
    assert config.load(env={}, conf={"contactloom.log.level": "DEBUG"}).log.level == "DEBUG"
    for bad in ({"CRAWLER__MAX_DELAY_PER_DOMAIN": "1"}, {"CRAWLER__MAX_RETRIES": "99"}, {"PROFILE": "x"}, {"LOG__LEVEL": "LOUD"}, {"CONCURRENCY": "0"}):
        with pytest.raises(ValueError):
            config.load(env=bad)


def test_seeds(spark, tmp_path):
    (tmp_path / "s.csv").write_bytes("﻿url,company\n https://a.org ,A\nftp://b,B\n,C\nhttp://c.org,\n".encode())
    assert sorted(r.url for r in seeds.seed_urls(spark, str(tmp_path / "s.csv")).collect()) == ["http://c.org", "https://a.org"]
    (tmp_path / "none.csv").write_text("site\nhttps://a.org\n")
    (tmp_path / "bad.csv").write_text("url\nx\n")
    for name in ("none.csv", "bad.csv"):
        with pytest.raises(ValueError):
            seeds.seed_urls(spark, str(tmp_path / name))
    assert seeds.chamber_urls(spark, str(tmp_path / "missing.csv")).count() == 5
    assert seeds.chamber_source(spark, ["anything"]).first().url == "anything"
    with pytest.raises(ValueError):
        seeds.chamber_source(spark)


def test_fetch_outcomes(spark):
    def fake(url, headers, timeout):
        kind = url.rsplit("/", 1)[1]
        return ("<p>ok</p>", 200, url + "/end") if kind == "ok" else (None, int(kind), url)

    urls = spark.createDataFrame([(f"https://a.org/{k}",) for k in ("ok", "404", "408", "599")] + [("nonsense",), (None,), ("https://deny.org/ok",)], "url STRING")
    robots = spark.createDataFrame([("deny.org", "User-agent: *\nDisallow: /"), ("a.org", None)], "domain STRING, body STRING")
    quick = config.CrawlerSettings(min_delay_per_domain=0, max_delay_per_domain=0, max_retries=1)
    got = {r.url: (r.status_code, r.final_url) for r in pages.fetch(urls, quick, fake, robots, sleep=lambda s: None).collect()}
    assert got["https://a.org/ok"] == (200, "https://a.org/ok/end")
    assert [got[f"https://a.org/{k}"][0] for k in ("404", "408", "599")] == [404, 408, 599]
    assert (got["nonsense"][0], got[None][0], got["https://deny.org/ok"][0]) == (0, 0, 403)


def test_retries():
    calls, waits = [], []

    def flaky(url, headers, timeout):
        calls.append(url)
        return (None, 503, url) if len(calls) < 3 else ("x", 200, url)

    settings = config.CrawlerSettings(max_retries=3)
    assert pages.retried(flaky, settings, waits.append)("u", {}, 1)[1] == 200
    assert len(calls) == 3 and 0.5 <= waits[0] <= 1.5 and 1 <= waits[1] <= 3
    calls.clear()
    assert pages.retried(lambda *a: calls.append(1) or (None, 404, "u"), settings, waits.append)("u", {}, 1)[1] == 404
    assert len(calls) == 1


def test_robots_source(spark):
    def fake(url, headers, timeout):
        return ("User-agent: *", 200, url) if url == "http://a.org/robots.txt" else (None, 404, url)

    got = pages.robots_rules(spark.createDataFrame([("a.org",), ("b.org",), (None,)], "domain STRING"), fake).collect()
    assert {r.domain: r.body for r in got} == {"a.org": "User-agent: *", "b.org": None}


def test_answers(spark):
    good = '```json\n{"business_listings":[{"name":" A ","website":null,"phone":""},{"phone":"1"}],"pagination":{"next_page_url":"/2"}}\n```'
    short = '{"business_listings":[{"name":"B"},{"name":"C"}, {"na'
    df = spark.createDataFrame([(1, "https://d.org/1", good), (2, "https://d.org/x", short), (3, "u", "no json"), (4, "u", None)], "id INT, url STRING, answer STRING")
    got = sorted((r.id, r.name, r.phone, r.source_url) for r in directory.listings(df).collect())
    assert got == [(1, "A", None, "https://d.org/1"), (2, "B", None, "https://d.org/x"), (2, "C", None, "https://d.org/x")]
    assert [r.n for r in df.select(directory.next_page(F.col("answer"), F.col("url")).alias("n")).collect()] == ["https://d.org/2", None, None, None]


def test_pagination(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)] + [(f"p{i}", f"p{i + 1}") for i in range(80)], "url STRING, next_url STRING")
    walks = directory.pagination(spark.createDataFrame([("a",), ("b",), ("d",), ("p0",)], "start STRING"), links)
    n = {r.start: r["count"] for r in walks.groupBy("start").count().collect()}
    assert n == {"a": 3, "b": 3, "d": 1, "p0": 50}
    assert directory.visited_once(walks).where("start in ('a', 'b')").count() == 3


def test_rule_based_extractor():
    page = '<a href="/members">Members</a><div class="listing-card"><h3>Acme</h3><a href="https://acme.org">w</a><a href="mailto:a@acme.org?x">m</a><span class="phone">1</span><address>Road 1</address></div><a href="?p=2">Next</a>'
    got = json.loads(directory.rule_based("https://d.org/list", page))
    assert got["business_listings"] == [{"name": "Acme", "website": "https://acme.org", "phone": "1", "email": "a@acme.org", "address": "Road 1", "industry": None}]
    assert got["pagination"] == {"next_page_url": "https://d.org/list?p=2", "has_more": True}
    assert got["navigation_links"] == ["https://d.org/members"]


def page(url, name):
    return (url, f"<title>Home | {name}</title><p>(415) 555-2671</p>", 200, url)


def test_sites_to_leads_and_export(spark, tmp_path):
    got = spark.createDataFrame([page("https://a.org/", "Firm A"), page("https://b.org/", "Firm B"), ("https://c.org/", "<p>nothing</p>", 200, "https://c.org/"), ("https://d.org/", None, 404, "https://d.org/")], pages.PAGE_DDL)
    leads = Leads(spark, str(tmp_path / "leads"))
    assert cli.run_sites(spark, config.Settings(), leads, got) == {"processed": 4, "saved": 2, "failed": 2}
    rows = leads.read().orderBy("id").collect()
    assert [(r.id, r.company_name, r.phone_numbers) for r in rows] == [(1, "Firm A", ["+14155552671"]), (2, "Firm B", ["+14155552671"])]
    assert report.completeness(leads.read()).first().phones_pct == 100.0
    assert export_csv(leads.read(), str(tmp_path / "out"), 1, single_file=True)
    out = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert [(r.id, r.company_name, r.phone_numbers) for r in out] == [("2", "Firm B", "+14155552671")]
    with pytest.raises(ValueError):
        leads.append(spark.createDataFrame([("x",)], "company_name STRING"))
    assert leads.read().count() == 2


def test_chambers_to_leads(spark, tmp_path):
    home = ("https://chamber.org", '<a href="/members">Members</a>', 200, "https://chamber.org")
    first = ("https://chamber.org/members", '<div class="listing"><h3>Acme</h3><a href="https://acme.org">w</a></div><a rel="next" href="/members/2">x</a>', 200, "")
    second = ("https://chamber.org/members/2", '<div class="listing"><h3>Acme</h3><a href="https://acme.org">w</a></div><div class="listing"><h3>Bolt</h3></div>', 200, "")
    got = spark.createDataFrame([home, first, second], pages.PAGE_DDL)
    leads = Leads(spark, str(tmp_path / "leads"))
    for _ in range(2):
        assert cli.run_chambers(spark, config.Settings(), leads, ["https://chamber.org"], fetched=got) == {"success": True}
        assert sorted((r.company_name, r.website) for r in leads.read().collect()) == [("Acme", "https://acme.org"), ("Bolt", None)]
    leads.vacuum()
    assert leads.read().count() == 2


def test_empty_table(spark, tmp_path):
    leads = Leads(spark, str(tmp_path / "leads"))
    with pytest.raises(ValueError):
        leads.read()
    leads.create()
    assert not export_csv(leads.read(), str(tmp_path / "out")) and not (tmp_path / "out").exists()
    assert save_results(leads, leads.read())["success"] is False
    s = report.statistics(leads.read()).first()
    assert (s.total_leads, s.leads_with_emails_pct, s.unique_domains) == (0, 0.0, 0)
    assert report.completeness(leads.read()).first().emails_pct == 0.0


def test_schedule_and_status(spark):
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 4.0), ("b", 1, 9.0), ("a", 3, 1.0)], "domain STRING, seq INT, delay DOUBLE")
    assert sorted((r.domain, r.seq, r.start) for r in fetch.schedule(df).collect()) == [("a", 1, 0.0), ("a", 2, 3.0), ("a", 3, 7.0), ("b", 1, 0.0)]
    assert cli.main(["config"]) == 0
    assert dataclasses.asdict(config.Settings())["profile"] == "strict"


def test_streaming(spark, tmp_path):
    from contactloom.streaming import pages as stream

    rows = [(1, "https://a.org/", "<title>x | Firm A</title>", "2024-01-01 00:00:00"), (2, "https://a.org/", "<title>x | Firm A</title>", "2024-01-01 00:01:00"), (3, "https://b.org/", "<title>x | Firm B</title>", "2024-01-01 00:02:00")]
    spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING, t STRING").withColumn("fetched_at", F.col("t").cast("timestamp")).drop("t").write.parquet(str(tmp_path / "drops"))
    leads = Leads(spark, str(tmp_path / "leads"))
    leads.create()
    q = stream.store(stream.first_seen(stream.page_drops(spark, str(tmp_path / "drops"))), leads, str(tmp_path / "ck"))
    q.awaitTermination()
    assert sorted((r.company_name, r.website) for r in leads.read().collect()) == [("Firm A", "https://a.org"), ("Firm B", "https://b.org")]


def test_browser_plug_and_second_retries():
    from contactloom.sources import pages

    seen, waits = [], []

    def render(url, timeout):
        seen.append(timeout)
        if len(seen) < 3:
            raise RuntimeError("no browser")
        return "<p>x</p>", 200, url

    assert pages.rendered(render)("u", {}, 5.0) == (None, 598, "u") and seen == [10.0]
    assert pages.insistent(pages.rendered(render), sleep=waits.append)("u", {}, 5.0) == ("<p>x</p>", 200, "u") and waits == [2.0]
    waits.clear()
    assert pages.insistent(lambda *a: (None, 404, "u"), sleep=waits.append)("u", {}, 1.0)[1] == 404 and waits == [2.0, 4.0]
