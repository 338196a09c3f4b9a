import pytest
from pyspark.sql import functions as F

from pageloom.functions import urls
from pageloom.operators import links
from pageloom.sources.pages import seeds

BASE = "http://Ex.com:80/a/b/c?q=1#f"
RESOLVED = {
    "/x": "http://ex.com/x",
    "x": "http://ex.com/a/b/x",
    "../x": "http://ex.com/a/x",
    "./": "http://ex.com/a/b/",
    "..": "http://ex.com/a/",
    "../../../..": "http://ex.com/",
    "//h.org/x": "http://h.org/x",
    "\\\\h2\\p": "http://h2/p",
    "?z=2": "http://ex.com/a/b/c?z=2",
    "#g": "http://ex.com/a/b/c?q=1#g",
    "": "http://ex.com/a/b/c?q=1",
    "HTTP:foo": "http://ex.com/a/b/foo",
    "https:foo": "https://foo/",
    "https://EX.com:443": "https://ex.com/",
    "https://ex.com:80/": "https://ex.com:80/",
    "http://ex.com:8080/%7Efoo/./bar/../für the,": "http://ex.com:8080/%7Efoo/f%C3%BCr%20the,",
    "http://u:p@ex.com/": "http://u:p@ex.com/",
    "/a b\"c<d>`{}": "http://ex.com/a%20b%22c%3Cd%3E%60%7B%7D",
    "/..%2e/.%2E": "http://ex.com/",
    "/a//b/": "http://ex.com/a//b/",
    "  /t\tab ": "http://ex.com/tab",
    "/emoji/\U0001f600": "http://ex.com/emoji/%F0%9F%98%80",
    "/100%25+1": "http://ex.com/100%25+1",
    "http://[::1]:80/x": "http://[::1]/x",
    "http://ex.com:0080/x": "http://ex.com/x",
    "http://B\u00fccher.de/x": "http://xn--bcher-kva.de/x",
    "//stra\u00dfe.de/": "http://xn--strae-oqa.de/",
    "http://%65x.com/": "http://ex.com/",
    "http://\uff25\uff38\u3002com/": "http://ex.com/",
    "https://u@0x7f.1:8080/": "https://u@127.0.0.1:8080/",
    "http://[2001:DB8:0:0:0::1]:80/": "http://[2001:db8::1]/",
    "http://ex.com%00/": None,
    "http://1.2.3.400/": None,
    "http://ex.com:99999/": None,
    "http://bad host/": None,
    "http://": None,
    "mailto:a@ex.com": None,
    "javascript:void(0)": None,
}


def test_resolve(spark):
    df = spark.createDataFrame([(h,) for h in RESOLVED], "h string")
    got = {r.h: r.u for r in df.select("h", urls.resolve_url(F.lit(BASE), F.col("h")).alias("u")).collect()}
    assert got == RESOLVED


@pytest.mark.parametrize("url,want", [
    ("http://ex.com?x=1", "http://ex.com/"),
    ("HTTPS://Ex.COM/A/B?x#y", "https://ex.com/A/B"),
    ("ex.com/x", None),
    ("ftp://ex.com:21/x", "ftp://ex.com/x"),
    (None, None),
])
def test_canonical(spark, url, want):
    row = spark.createDataFrame([(url,)], "u string").select(urls.canonical_url(F.col("u"))).first()
    assert row[0] == want


@pytest.mark.parametrize("url,anchor,hundredths", [
    ("http://x.example/", "Home", 40),
    ("http://x.example/news/2024/05/item", "Top news", 77),
    ("http://x.example/login", "Sign in", 20),
    ("http://x.example/tag/page/feed", "", 0),
    ("http://stage.example/", "", 20),
    ("http://x.example/a/b/c/d/e/f/g", "", 40),
    ("http://x.example/news/story/world/report/blog/post", "news story post blog report", 100),
    ("http://x.example/sitemap", "", 40),
])
def test_score(spark, url, anchor, hundredths):
    df = spark.createDataFrame([(url, anchor)], "u string, a string")
    row = df.select(urls.link_score(F.col("u"), F.col("a")), urls.link_priority(F.col("u"), F.col("a"))).first()
    assert row[0] == hundredths and row[1] == hundredths / 100


PAGE = """<nav><a href="/news/1">First</a><a href="/about">About <b>us</b></a>
<a href="/news/1?again#x">News again</a><a href="http://www.ex.com/other">www</a>
<a href="//ex.com:8080/port">port</a><a href="mailto:a@ex.com">mail</a><a name="none">none</a>
<a href="">self</a><a href="/plain">plain</a></nav>"""


def test_ranked_links(spark, pages):
    table = pages({"http://ex.com/a": PAGE, "http://ex.com/empty": "<p>x", "not a url": PAGE})
    rows = links.ranked_links(table).orderBy("page_url", "rank").collect()
    assert [(r.rank, r.pos, r.url, r.anchor, r.priority) for r in rows] == [
        (1, 0, "http://ex.com/news/1", "First", 0.48),
        (2, 4, "http://ex.com:8080/port", "port", 0.4),
        (3, 6, "http://ex.com/a", "self", 0.4),
        (4, 7, "http://ex.com/plain", "plain", 0.4),
        (5, 1, "http://ex.com/about", "About us", 0.2),
    ]
    assert {r.depth for r in rows} == {1}
    assert links.ranked_links(table, limit=2).count() == 2
    own = links.ranked_links(table, article_signals=["plain"], noise_signals=[]).orderBy("rank").first()
    assert own.url == "http://ex.com/plain" and own.priority == 0.52


def test_page_links_keep_everything(spark, pages):
    rows = links.page_links(pages({"http://ex.com/a": PAGE})).orderBy("pos").collect()
    assert [r.href for r in rows][:3] == ["/news/1", "/about", "/news/1?again#x"]
    assert len(rows) == 8


def test_default_cut_and_summary(spark, pages):
    many = "".join(f'<a href="/p{i}">x</a>' for i in range(200))
    table = pages({"http://ex.com/": many, "http://ex.com/none": ""})
    ranked = links.ranked_links(table)
    assert ranked.count() == 30
    assert [r.pos for r in ranked.orderBy("rank").collect()] == list(range(30))
    assert links.ranked_links(table, limit=None).count() == 200
    rows = {r.seed_url: (r.n_links, r.best_priority) for r in links.frontier_summary(seeds(table), ranked).collect()}
    assert rows == {"http://ex.com/": (30, 0.4), "http://ex.com/none": (0, 0.0)}


def test_url_functions_follow_each_other(spark):
    df = spark.createDataFrame([("http://bücher.de/a/", "../x?y"), ("http://0x7f.1/", "//%42.de")], "b string, h string")
    resolved = df.select("b", urls.resolve_url(F.col("b"), F.col("h")).alias("u")).select(
        urls.canonical_url(F.col("u")).alias("c"), urls.host(F.col("u")).alias("h"))
    rows = resolved.select("c", "h", urls.path_depth(F.col("c")).alias("d"), urls.link_priority(F.col("c"), F.lit("x")).alias("p")).collect()
    assert [(r.c, r.h, r.d) for r in rows] == [("http://xn--bcher-kva.de/x", "xn--bcher-kva.de", 1), ("http://b.de/", "b.de", 0)]


def test_links_to_other_spellings_of_the_host_are_kept(spark, pages):
    html = "".join(f'<a href="{h}/{i}">l{i}</a>' for i, h in enumerate([
        "http://BÜCHER.example", "http://xn--bcher-kva.example", "http://b%C3%BCcher.example:8080", "//bücher.example", "http://buecher.example", "http://xn--a"]))
    table = pages({"http://bücher.example/": html, "http://10.0.0.1/": '<a href="http://0xa.1/x">x</a><a href="http://167772161/y">y</a>'})
    got = {(r.page_url, r.url) for r in links.ranked_links(table).collect()}
    host = "xn--bcher-kva.example"
    assert got == {("http://bücher.example/", f"http://{host}/{i}") for i in (0, 1, 3)} | {
        ("http://bücher.example/", f"http://{host}:8080/2")} | {("http://10.0.0.1/", f"http://10.0.0.1/{p}") for p in "xy"}
