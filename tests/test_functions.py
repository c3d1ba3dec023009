import pytest
from pyspark.sql import functions as F

from contactloom.functions import contacts as C
from contactloom.functions import text, urls


def check(spark, cases, f):
    """``cases``: input (or inputs) and what is expected."""
    rows = [(i, *(c[0] if isinstance(c[0], tuple) else (c[0],))) for i, c in enumerate(cases)]
    width = len(rows[0]) - 1
    df = spark.createDataFrame(rows, "i INT, " + ", ".join(f"x{k} STRING" for k in range(width)))
    got = {r.i: r.y for r in df.select("i", f(*[F.col(f"x{k}") for k in range(width)]).alias("y")).collect()}
    for i, (given, expected) in enumerate(cases):
        assert got[i] == expected, (given, got[i], expected)


def test_clean_text(spark):
    check(spark, [("  a \t b\n", "a b"), ("", None), ("   ", None), (None, None), ("x  y", "x y"), ("one", "one")], text.clean_text)


def test_normalize_email(spark):
    check(spark, [("  Info@Firm.ORG ", "info@firm.org"), ("no", None), ("a@b", None), (None, None), ("a@b.co x", None), ("", None), ("x+y@z.io", "x+y@z.io")], text.normalize_email)


def test_emails_in_text(spark):
    check(spark, [("b@x.org, A@x.org and a@x.org", ["a@x.org", "b@x.org"]), ("none", []), (None, []), ("", [])], text.emails_in)


def test_deobfuscation(spark):
    check(spark, [("a [at] b [dot] org", "a@b.org"), ("a(AT)b(Dot)org", "a@b.org"), ("meet us at acme.com", "meet us@acme.com"), ("a at b dot org", "a@b.org")], text.deobfuscate)


def test_titles(spark):
    check(spark, [("Home | Acme Works", "Acme Works"), ("Acme Works", None), ("A - B – C", "C"), ("Acme | Home", None), ("Home", None), ("Coca-Cola", "Cola"), (None, None)], text.company_in_title)


def test_copyright_holder(spark):
    check(spark, [("© 2024 Copyright Holder Inc.", "Copyright Holder"), ("© 2019-2024 Acme. All Rights Reserved", "Acme"), ("no sign", None), ("© Acme Works LLC", "Acme Works"), (None, None)], text.copyright_holder)


def test_registered_domain(spark):
    check(spark, [
        ("https://www.a.example.co.uk/x", "example.co.uk"), ("http://sub.firm.com:80/", "firm.com"), ("firm.org", "firm.org"), ("http://192.168.0.1/x", "192.168.0.1"), ("localhost", "localhost"),
        ("mailto:a@firm.com", None), ("tel:123", None), ("", None), (None, None), ("http://nodots/", None), ("https://user:pw@Shop.Firm.com", "firm.com"),
    ], urls.registered_domain)


def test_absolute_links(spark):
    base = "https://firm.org/a/b.html"
    check(spark, [
        ((base, "/c"), "https://firm.org/c"), ((base, "//x.org/y"), "https://x.org/y"), ((base, "http://z.org"), "http://z.org"), ((base, "www.q.org/r"), "http://www.q.org/r"), ((base, "page.html"), "http://page.html"),
        ((base, " "), None), ((base, None), None), ((base, "?q=1"), "https://firm.org/a/b.html?q=1"), ((base, "sub/page"), "https://firm.org/a/sub/page"), ((base, "../up"), "http://../up"), ((base, "mailto:a@b.c"), "mailto:a@b.c"), ((base, "#top"), "https://firm.org/a/b.html#top"),
    ], urls.absolute)
    check(spark, [((base, "page.html"), "https://firm.org/a/page.html"), ((base, "shop.com/x"), "http://shop.com/x"), ((base, "../up"), "https://firm.org/up")], lambda b, x: urls.absolute(b, x, strict=False))


def test_websites(spark):
    check(spark, [("https://Firm.org:8080/x", "https://Firm.org:8080"), ("https://example.com/x", None), ("https://www.example.com/x", "https://www.example.com"), ("none", None)], urls.website)
    check(spark, [(("https://firm.org/a", "https://src.org/x"), "https://firm.org"), (("https://example.com/a", "https://src.org/x"), "https://src.org"), ((None, "https://x.test/"), None)], urls.website_extended)


def test_generic_phone(spark):
    check(spark, [("555-0100", True), ("(555) 555-5555", True), ("222-2222", True), ("415-555-2671", False), (None, False), ("", False), ("22", False)], C.is_generic_phone)
    check(spark, [("1-800-555-0199", True)], lambda c: C.is_generic_phone(c, contained=True))


def test_generic_email(spark):
    check(spark, [("Info@Example.com", True), ("me@domain.com", True), ("a@b.invalid", True), ("x@mail5.example.com", False), ("x@firm.org", False), (None, False), ("nothing", False)], C.is_generic_email)
    check(spark, [("info@b.test", False), ("jane@yourname.test", True)], lambda c: C.is_generic_email(c, extended=True))


def test_cloudflare(spark):
    def coded(mail, key=0x5A):
        return f"{key:02x}" + "".join(f"{ord(c) ^ key:02x}" for c in mail)

    check(spark, [(coded("a@b.org"), "a@b.org"), (C.CLOUDFLARE + coded("x@y.net", 1), "x@y.net"), ("zz", None), ("", None), (None, None), ("5", None)], C.decode_cloudflare)


def test_phone_cleaning(spark):
    check(spark, [("Phone: 415-555-2671", "415-555-2671"), ("tel 415 555 2671 ext. 12", "415 555 2671"), ("1-800 GOOD BOY", "1-800 GOODBOY"), ("Fax:  1  2", "1 2")], C.clean_phone)


def test_e164(spark):
    check(spark, [
        ("(415) 555-2671", "+14155552671"), ("+1 415.555.2671", "+14155552671"), ("1-800-FLOWERS", "+18003569377"), ("+44 20 7946 0958", "+442079460958"), ("115-555-2671", None), ("415-155-2671", None),
        ("12", None), ("(555) 555-5555", None), ("", None), (None, None), ("415 555 2671 x99", "+14155552671"), ("4149601755386017", None),
    ], C.to_e164)


def test_phones_in_text(spark):
    check(spark, [("Call (415) 555-2671 or 212-555-7788; not 555-555-5555.", ["+12125557788", "+14155552671"]), ("nothing", []), (None, [])], C.phones_in)


def test_address_shapes(spark):
    check(spark, [("12 Main Road, Austin TX 75001", True), ("No. 7, Platz 1, 10115 Berlin", True), ("No. 7, 10115 Berlin", False), ("Main Road", False), ("1 a 12345", False), (None, False)], C.address_shaped)


@pytest.mark.parametrize("extended", [False, True])
def test_social(spark, extended):
    cases = [
        ("https://www.linkedin.com/company/acme", "linkedin", "linkedin"), ("https://linkedin.com/feed/", None, None), ("https://x.com/acme", "twitter", "twitter"), ("https://twitter.com/intent/tweet", None, None),
        ("https://facebook.com/acme", None, "facebook"), ("https://www.facebook.com/pages/acme/1", "facebook", "facebook"), ("https://facebook.com/profile.php?id=12", None, "facebook"), ("https://youtube.com/acme", None, "youtube"),
        ("https://youtube.com/channel/abc", "youtube", "youtube"), ("https://instagram.com/acme/", "instagram", "instagram"), ("https://tiktok.com/acme", "tiktok", "tiktok"), ("https://example.org", None, None), ("nonsense", None, None), (None, None, None),
    ]
    check(spark, [(u, b if extended else a) for u, a, b in cases], lambda c: C.social_platform(c, extended))


def test_captcha(spark):
    check(spark, [("<p>Please solve the reCAPTCHA</p>", True), ("<p>fine</p>", False), (None, False), ("x" * 2600 + "captcha", False)], text.captcha)


def test_markdown(spark):
    check(spark, [("<h1>T</h1><script>no()</script><ul><li>a</li><li><a href='/x'>b</a></li></ul>", "# T\n\n- a\n- [b](/x)"), ("<h3 id=a>U</h3>x", "### U\nx")], text.markdown)
    check(spark, [("abcdef", "abc" + text.CUT_MARK), ("ab", "ab")], lambda c: text.shortened(c, 3))
