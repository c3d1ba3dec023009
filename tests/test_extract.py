import pytest
from pyspark.sql import functions as F

from contactloom.operators import extract
from contactloom.functions import contacts as C
from contactloom.functions import dom
from contactloom.plans import catalog

FULL = """<html><head><title>Products | Complex Page Shop</title>
<meta property="og:site_name" content="Complex Page Ltd"><meta property="og:description" content="All that we make, in one place."><link rel="canonical" href="/contact"></head>
<body><div itemscope itemtype="http://schema.org/Organization"><span itemprop="name">Complex Org</span>
<div itemprop="address" itemtype="http://schema.org/PostalAddress"><span itemprop="streetAddress">7 Elm Row</span><span itemprop="addressLocality">Austin</span><span itemprop="addressRegion">TX</span></div></div>
<p>Phone: <b>(415)</b> <i>555-2671</i>, mail <a href="mailto:Info@complex.org?subject=hi">us</a> or sales [at] complex [dot] org</p>
<a href="tel:+442079460958">ring</a><a href="https://youtube.com/channel/x">yt</a><a href="https://linkedin.com/company/c">in</a><a href="https://linkedin.com/company/d">in</a>
<footer>© 2024 Complex Footer Inc.</footer></body></html>"""


def record(spark, html, url="https://complex.org/p", profile="strict"):
    r = extract.extract(spark.createDataFrame([(url, html)], "url STRING, html STRING"), profile).drop("html").first()
    return r.asDict()


def test_full_page(spark):
    r = record(spark, FULL)
    assert r["company_name"] == "Complex Page Ltd"
    assert r["phone_numbers"] == ["+14155552671", "+442079460958"]
    assert r["emails"] == ["info@complex.org", "sales@complex.org"]
    assert r["addresses"] == ["7 Elm Row, Austin, TX"]
    assert r["social_media_links"] == {"linkedin": "https://linkedin.com/company/c", "youtube": "https://youtube.com/channel/x"}
    assert r["description"] == "All that we make, in one place."
    assert r["canonical_url"] == "https://complex.org/contact"
    assert r["website"] == "https://complex.org"


def test_name_order(spark):
    pages = {
        "<meta property='og:site_name' content='Home'><div itemtype='x/Organization'><b itemprop=name>Org</b></div>": "Org",
        "<meta property='og:title' content='Page | Firm A'><title>X | Firm B</title>": "Firm A",
        "<meta property='og:title' content='Whole Title'><title>X | Firm B</title>": "Firm B",
        "<meta property='og:title' content='Whole Title'><footer>© 2020 Foot</footer>": "Whole Title",
        "<meta property='og:title' content='Part | Contact'><footer>© 2020 Foot</footer>": "Foot",
        "<title>My Awesome Company</title>": None,
        "<h1>Main Title Co</h1>": None,
    }
    df = spark.createDataFrame([("https://a.org", h) for h in pages], "url STRING, html STRING")
    got = {r.html: r.company_name for r in extract.extract(df).select("html", "company_name").collect()}
    assert got == pages


def test_empty_pages(spark):
    for html in (None, "", "plain", "<p>A very basic page"):
        r = record(spark, html)
        assert (r["company_name"], r["phone_numbers"], r["emails"], r["addresses"], r["social_media_links"], r["description"]) == (None, [], [], [], {}, None)
    with pytest.raises(ValueError):
        record(spark, "", profile="other")


def test_extended(spark):
    page = "<title>My Awesome Company</title><span class='__cf_email__' data-cfemail='5a3b1a382275352820'></span><a href='https://facebook.com/Name'>f</a><link rel=canonical href='https://canon.org/x'>"
    r = record(spark, page, profile="extended")
    assert r["company_name"] == "My Awesome Company"
    assert r["social_media_links"] == {"facebook": "https://facebook.com/Name"}
    assert r["website"] == "https://canon.org"
    assert record(spark, "<footer>© 2024 Copyright Holder Inc.</footer>", profile="extended")["company_name"] == "Copyright Holder Inc."


def test_element_text():
    tree = dom.Tree("<div>a<b> b</b><script>no</script><p>c&nbsp;d<br>e – f</div>")
    assert dom.text_of(tree.root) == "a b c d e - f"
    assert dom.text_of(None) is None
    assert dom.text_of(dom.Tree("<p></p></b></p>x").root) == "x"


def test_content_gate(spark):
    rows = [("a", None, None), (None, [], ["1"]), (None, ["m"], []), ("", [], []), (None, None, None)]
    df = spark.createDataFrame(rows, "company_name STRING, emails ARRAY<STRING>, phone_numbers ARRAY<STRING>")
    assert extract.worth_keeping(df).count() == 3


def test_one_python_step(spark):
    df = spark.createDataFrame([("https://a.org", "")], "url STRING, html STRING")
    out = extract.extract(df).drop("canonical_url")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_once_per_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id INT, html STRING")
    out = extract.once_per_content(df, lambda d: d.withColumn("n", F.length("html"))).orderBy("id").collect()
    assert [r.n for r in out] == [1, 1, None]


def test_a_plug_for_names_comes_last(spark):
    rows = [(1, "https://a.org", "<h1>Welcome to Acme Works of Boston</h1>"), (2, "https://b.org", "<h1>Welcome to Acme Works</h1><footer>&copy; 2024 Other Ltd</footer>"), (3, "https://c.org", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "id INT, url STRING, html STRING")
    plug = lambda h1: F.nullif(F.regexp_extract(h1, "to (\\w+ Works)", 1), F.lit(""))
    got = {r.id: r.company_name for r in extract.extract(pages, organisation=plug).collect()}
    assert got == {1: "Acme Works", 2: "Other", 3: None}
    assert [r.company_name for r in extract.extract(pages).orderBy("id").collect()] == [None, "Other", None]


def test_a_numbered_name_in_a_notice_is_no_address(spark):
    no = ["&copy; 2024 Firm 10000 Inc.", "&copy; 2024 Firm 123456789 Inc.", "Copyright &copy; 2019 - 2024 Firm 10000. All rights reserved."]
    yes = ["&copy; 2024 Firm Inc. 12 Elm Row, Austin, TX 75001", "&copy; 2024 Firm, Platz 1, 10115 Berlin", "&copy; 2024 Firm Platz 1 10115 Berlin", "&copy; 2024 Firm 10000 Inc. 7 Elm Row 75001", "&copy; 2024 Firm. 10115 Berlin", "2024 Firm 10000"]
    rows = [("https://a.org", f"<footer>{t}</footer>") for t in no + yes]
    got = {r.html: r.addresses for r in extract.extract(spark.createDataFrame(rows, "url STRING, html STRING")).select("html", "addresses").collect()}
    assert got == {f"<footer>{t}</footer>": [] if t in no else [t.replace("&copy;", "©")] for t in no + yes}


def test_records_of_long_keys_are_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    path = str(tmp_path / "supplier.parquet")
    spark.createDataFrame([(k,) for k in (7, 9999, 10000, 59999, 359998, 1234567)], "s_suppkey LONG").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{path}/*.parquet'")
    for name in ("page_records", "page_records_extended", "page_records_wide"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES[name]}) ORDER BY s_suppkey").fetchall()
        assert [tuple(r) for r in df.orderBy("s_suppkey").collect()] == expected


def test_pages_are_walked_once_and_in_as_many_tasks_as_they_need(spark, tmp_path):
    spark.range(9000).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    for name in ("page_records", "page_records_extended", "page_records_wide"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython [run(") == 1 and "RoundRobinPartitioning(5)" in plan


def test_an_address_is_parsed_once_for_its_line(spark):
    line = C.format_address(C.parse_address(F.col("t")))
    df = spark.createDataFrame([("12 Elm Road, Apt 4, Austin, TX 75001",)], "t STRING").select(line.alias("line"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract(") == 7 and df.first().line == "12 Elm Road Apt 4, Austin, TX 75001"


def test_no_pages(spark):
    pages = spark.createDataFrame([("a", "b")], "url STRING, html STRING").where("url = 'c'")
    assert extract.worth_keeping(extract.extract(pages, "extended")).count() == 0
