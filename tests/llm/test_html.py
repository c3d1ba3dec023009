import pytest

from contactloom.llm import html_wrapper as hw
from contactloom.llm import queries
from tests.llm import plain

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t = "</p><article>no";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Title {n} &lt;b&gt;</h1><p><b>First {n} <i>part</i>of<br><p>Second&nbsp;{n}
 line</p><ul><li>one{n}<li>two{n}</ul><div class="share-links">Share</div><form><p>Form</p></form></article>
<aside>Side</aside><section id="comments"><p>Nice!</p></section><footer>&copy; me</footer></body></html>"""
TEXT = "Title {n} <b> First {n} partof Second {n} line one{n} two{n}"


def test_main_text():
    assert hw.text_of(PAGE.format(n=1)) == TEXT.format(n=1)


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a</p>b<p>c", "a b c"),
        ("<div role='navigation'>x</div><div>y</div>", "y"),
        ("<main><h1>m</h1><p>n</p></main><p>out</p>", "m n"),
        ("<article>short</article><p>between</p><article>the longer one</article>", "short the longer one"),
        ("<main><p>a</p><article>b</article></main>", "a b"),
        ("<article><p class='search-results'>a</p><p class='related-work'>b</p><p id='comment-on-law'>c</p><div class='share-links'>no</div><div class='comments'>no</div></article>", "a b c"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p>", "if x=2 then"),
        ("<p title='" + "b" * 30_000 + ">no'>T</p>", "T"),
        ('<p title="never closed>a</p><p class="x>b</p>', "b"),
        ("<p>a<script>x</script>b</p>", "ab"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<nav>menu<article>kept</article>", "kept"),
        ("<p title='a>b'>q</p>", "q"),
        ("<p hidden>no</p><p>yes</p>", "yes"),
        ("<article><p>a</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "a deep"),
    ],
)
def test_forms(page, text):
    assert hw.text_of(page) == text


def test_long_and_odd_pages():
    """Depth, open quotes and stray tags cost what their length does."""
    import time

    began = time.perf_counter()
    deep = "".join(f"<div>t{k}" for k in range(50_000))
    assert len(hw.text_of(deep, frozenset(["x"])).split()) == 50_000
    assert hw.text_of("<p>a</p>" + '<a title="' * 100_000) == "a"
    assert hw.text_of("</b>" * 200_000 + "<i>" * 200_000 + "x") == "x" and hw.text_of("<" * 500_000) == "<" * 500_000
    assert len(hw.text_of("".join(f"<p class=c{k}x{'y' * (k % 7)}>{k}</p>" for k in range(30_000)), frozenset(["x"])).split()) == 30_000
    assert time.perf_counter() - began < 20


def test_alignment():
    """Texts that differ become slots, tokens of one side optional, neighbours and groups of one form a repetition; the order stays."""
    page = lambda n, k, extra="": hw.expression(hw.blocks(f"<body><div class=top>Site</div>{extra}<h1>t{n}</h1>" + "".join(f"<h2>h{n}{i}</h2><p>{n}{i}</p>" for i in range(k)) + "<div class=end>End</div></body>"))[0]
    w = page(1, 2)
    for other in (page(2, 1), page(3, 3, "<div class=box>maybe</div>")):
        w = hw.align(w, other)
    assert [(x[1] is not None, *x[2:5]) for x in w] == [(True, 3, False, False), (True, 1, False, True), (False, 3, False, False), (False, 3, True, False), (False, 3, True, False), (True, 3, False, False)]
    site, end = (f"{x[0]}:{x[1]}" for x in (w[0], w[-1]))
    assert hw.templates(w) == sorted([site, end])


def test_order_of_alignment_does_not_matter():
    pages = [f"<body><div>s</div><p>{k % 3}</p>{'<h2>o</h2>' * (k % 2)}</body>" for k in range(6)]
    def merged(order):
        found = None
        for k in order:
            e = hw.expression(hw.blocks(pages[k]))[0]
            found = e if found is None else hw.align(found, e)
        return hw.templates(found)
    assert merged(range(6)) == merged([5, 3, 1, 0, 2, 4])


def table(spark):
    rows = [(k, f"https://site.org/{k}", f"<body><div class=x>Our slogan</div><div><p>Body of {k}</p></div></body>") for k in range(6)]
    rows += [(10, "https://one.org/", PAGE.format(n=1)), (11, None, None), (12, "no host", "<p>t</p>"), (13, "https://one.org/", ""), (0, "https://site.org/0", rows[0][2]), (None, "https://two.org", "<p>n</p>"), (14, "https://big.org", "<article><p>" + "word " * 400_000 + "</p></article>")]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")


def test_template_texts_of_a_host_go(spark):
    got = {(r.page_id, r.url): r.text for r in hw.extract(table(spark)).collect()}
    assert all(got[k, f"https://site.org/{k}"] == f"Body of {k}" for k in range(6))
    assert got[10, "https://one.org/"] == TEXT.format(n=1)


def test_wrappers_decide_inside_articles(spark):
    """What stands in the same slot of many articles of a host is template, a menu without a telling tag or class too; of a few it may be theirs."""
    page = "<body><div><p>Home</p><p>About us</p></div><article><h1>Title {k}</h1><div>Filed under news</div><p>Text of {k}</p><p>More</p></article></body>"
    rows = [(k, f"https://{'many' if k < 25 else 'few'}.org/{k}", page.format(k=k)) for k in range(30)]
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k} " + ("" if k < 25 else "Filed under news ") + f"Text of {k} More" for k in range(30)}
    alone = {k: hw.text_of(h) for k, _, h in rows}
    assert sum(got[k] != alone[k] for k in got) == 25


def test_templates_against_plain(spark):
    """Against a plain count: a slot's text is template if it is the same on all of the host's pages that have it."""
    import random
    from collections import defaultdict

    rng = random.Random(3)
    rows, slots = [], defaultdict(lambda: defaultdict(list))
    for k in range(120):
        host = f"h{k % 4}.org"
        parts = [("a", f"slogan {k % 4}"), ("b", rng.choice(["x y", "z"])), ("c", f"body {k}")] + [("d", "only some")] * rng.randint(0, 1) + [("e", f"foot {k % 4}")]
        rows.append((k, f"http://{host}/{k}", "".join(f"<div class={c}>{t}</div>" for c, t in parts), parts))
        for c, t in parts:
            slots[host][c].append(t)
    got = {r.page_id: r.text for r in hw.extract(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(5)).collect()}
    out = lambda host, c: len(set(slots[host][c])) == 1 and len(slots[host][c]) >= hw.LEAST_PAGES
    assert got == {k: " ".join(t for c, t in parts if not out(url.split("/")[2], c)) for k, url, _, parts in rows}


def test_copies_of_an_article_keep_it(spark):
    rows = [(k, f"https://h.org/{k}", f"<body><article><h1>Same title</h1><p>{'Same text' if k < 5 else 'Other'}</p></article></body>") for k in range(6)]
    got = hw.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {k: "Same title " + ("Same text" if k < 5 else "Other") for k in range(6)}


def test_edges(spark):
    got = hw.extract(table(spark)).collect()
    assert len(got) == 13 and all(r.n_chars == len(r.text) for r in got)
    by = {r.page_id: r for r in got}
    assert by[11].text == by[13].text == "" and by[12].text == "t" and by[14].n_chars == 5 * 400_000 - 1
    assert hw.extract(table(spark).limit(0)).count() == 0


@pytest.mark.skipif(not plain.have_data(), reason="the driver's tables are not here")
def test_query(spark):
    import html
    import re

    pages = {r.page_id: r for r in spark.read.parquet(f"{plain.SMALL}/pages.parquet").collect()}
    got = queries.op6_html_wrapper_extraction(spark, plain.SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        # the fixture's articles have one element of each kind and no skipped regions inside
        article = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id].html)
        if article:
            pieces = re.split(r"<(?:/?(?:h1|p|div|ul|li)|br)\b[^>]*>", article[1])
            want = " ".join(x for x in (" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in pieces) if x)
            assert r.text == want and r.n_chars == len(want)
