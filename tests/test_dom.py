import time

import pytest
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import dom
from pageloom.functions.markup import parse_html
from pageloom.operators import dom as dom_ops


def outline(html):
    """(tag or text, parent tag) in document order."""
    tree = parse_html(html)
    name = lambda i: None if i < 0 else tree.tags[i]
    return [(tree.tags[i] or repr(tree.texts[i]), name(tree.parents[i])) for i in range(len(tree.tags))]


def below(html, tag):
    """Texts below the first element with this tag."""
    tree = parse_html(html)
    i = tree.tags.index(tag)
    return [t for t in tree.texts[i + 1: tree.ends[i] + 1] if t is not None]


def field(spark, name, html, documented=True):
    rows = spark.createDataFrame([("u", html)], "url string, html string").coalesce(1)
    return dom_ops.parse_pages(rows, ["url"]).select(dom.page_field(name, "nodes", documented)).first()[0]


@pytest.mark.parametrize("html,want", [
    ("<p>a<p>b", [("p", None), ("'a'", "p"), ("p", None), ("'b'", "p")]),
    ("<p>a<div>b</div></p>", [("p", None), ("'a'", "p"), ("div", None), ("'b'", "div"), ("p", None)]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", [
        ("ul", None), ("li", "ul"), ("'a'", "li"), ("li", "ul"), ("'b'", "li"), ("ul", "li"),
        ("li", "ul"), ("'c'", "li")]),
    ("<table><tr><td>1<td>2<tr><th>3</table>z", [
        ("table", None), ("tr", "table"), ("td", "tr"), ("'1'", "td"), ("td", "tr"), ("'2'", "td"),
        ("tr", "table"), ("th", "tr"), ("'3'", "th"), ("'z'", None)]),
    ("<h1>a<h2>b</h1>c", [("h1", None), ("'a'", "h1"), ("h2", None), ("'b'", "h2"), ("'c'", None)]),
    ("<div>a<br>b<img>c</div>", [
        ("div", None), ("'a'", "div"), ("br", "div"), ("'b'", "div"), ("img", "div"), ("'c'", "div")]),
    ("<div>a<!-- x -->b</nope>c</div>", [("div", None), ("'a'", "div"), ("'bc'", "div")]),
    ("<select><option>1<option>2</select>", [
        ("select", None), ("option", "select"), ("'1'", "option"), ("option", "select"), ("'2'", "option")]),
    ("<dl><dt>a<dd>b<dt>c</dl>", [
        ("dl", None), ("dt", "dl"), ("'a'", "dt"), ("dd", "dl"), ("'b'", "dd"), ("dt", "dl"), ("'c'", "dt")]),
    ("<a href=1>x<a href=2>y", [("a", None), ("'x'", "a"), ("a", None), ("'y'", "a")]),
    ("x < y &lt; z &copy &am", [("'x < y < z © &am'", None)]),
    ("<td>no table</td>", [("'no table'", None)]),
    ("<p>cut <b", [("p", None), ("'cut '", "p")]),
    ("<p title='never ends", []),
    ("<svg><path d='1'/><g>t</g></svg>", [
        ("svg", None), ("path", "svg"), ("g", "svg"), ("'t'", "g")]),
])
def test_tree(html, want):
    assert outline(html) == want


def test_raw_text_and_references():
    assert below("<script>if (a<b) '</p>' &amp;</script>", "script") == ["if (a<b) '</p>' &amp;"]
    assert below("<title>a &amp; <b>b</title>", "title") == ["a & <b>b"]
    assert below("<style>p{}</sTYLE >x", "style") == ["p{}"]
    assert below("<textarea>\n<p>x", "textarea") == ["<p>x"]


def test_attributes():
    tree = parse_html("""<A HREF='?a=1&copy=2&amp;b' class=x Class=y data-q="a>b" disabled x = "1"y=2>""")
    assert tree.attrs[0] == {
        "href": "?a=1&copy=2&b", "class": "x", "data-q": "a>b", "disabled": "", "x": "1", "y": "2"}


def test_head_ends_with_the_first_content():
    assert ("p", "html") in outline("<html><head><title>t</title><p>x")


def test_ends_are_intervals():
    html = "<div><p>a<b>b</b></p><ul><li>c</ul></div><i>d</i>"
    tree = parse_html(html)
    for i, parent in enumerate(tree.parents):
        assert parent < i <= tree.ends[i] < len(tree.tags)
        if parent >= 0:
            assert tree.ends[i] <= tree.ends[parent]


def test_long_unclosed_input_stays_linear():
    parse_html("<a b='" * 20000)
    parse_html("<!--" * 20000)
    for unit, end in (("<div>", "</div>"), ("<table><tr><td>", ""), ("<ul><li>", ""), ("<b><p>", "</b>"), ("x</i>", "")):
        started = time.process_time()
        parse_html(unit * 100_000 + "x" + end * 100_000)
        assert time.process_time() - started < 10


def test_title_chain(spark):
    og = '<meta property="og:title" content="  Open  ">'
    card = '<meta name="twitter:title" content="Card">'
    tag = "<title> Tag </title>"
    assert field(spark, "title", og + "<h1>Heading</h1>") == "Open"
    assert field(spark, "title", '<meta property="og:title" content=" ">' + "<h1>Heading</h1>") == "Heading"
    assert field(spark, "title", card + tag + "<h1>Four</h1><h1>Second</h1>") == "Card"
    assert field(spark, "title", card + tag + "<h1>Fives</h1>") == "Fives"
    assert field(spark, "title", tag + "<h1>éé</h1>") == "Tag"  # 4 bytes
    assert field(spark, "title", tag + "<h1>ééa</h1>") == "ééa"  # 5 bytes
    assert field(spark, "title", "<p>x</p>") == vocab.NO_TITLE
    assert field(spark, "title", "") == vocab.NO_TITLE
    assert field(spark, "title", None) == vocab.NO_TITLE


def test_author_chain(spark):
    meta = '<meta name="author" content="Meta">'
    article = '<meta name="article:author" content="Agency">'
    rel = '<a rel="author">Rel</a>'
    byline = '<i class="byline">By</i>'
    assert field(spark, "author", meta + article) == "Meta"
    assert field(spark, "author", meta + article, documented=False) == "Agency"
    assert field(spark, "author", rel + byline) == "Rel"
    assert field(spark, "author", rel + byline, documented=False) == "By"
    # the first match counts, even when it is empty or too long
    assert field(spark, "author", '<b class="author"></b><b class="author">2</b>' + byline) == "By"
    assert field(spark, "author", f'<b class="xauthor">{"n" * 120}</b>') is None
    assert field(spark, "author", f'<b class="xauthor">{"n" * 119}</b>') == "n" * 119
    assert field(spark, "author", f'<b class="author">{"é" * 60}</b>') is None
    assert field(spark, "author", '<b class="Author">case</b>') is None


def test_date_chain(spark):
    meta = '<meta property="article:published_time" content="2024">'
    assert field(spark, "published_date", meta + "<time datetime=1>x</time>") == "2024"
    assert field(spark, "published_date", "<time>t</time><time datetime=' 1 '>x</time>") == " 1 "
    assert field(spark, "published_date", "<time datetime=''>x</time>") == ""
    assert field(spark, "published_date", "<time> noon </time>") == "noon"
    assert field(spark, "published_date", "<b class=pub-date>May</b><b class=published>June</b>") == "June"
    assert field(spark, "published_date", f"<b class=update>{'d' * 59}</b>") == "d" * 59
    assert field(spark, "published_date", f"<b class=update>{'d' * 60}</b><b class=timestamp>7</b>") == "7"
    assert field(spark, "published_date", "<p>x") is None


def test_body_chain(spark):
    long, short = "b" * 100, "b" * 99
    assert field(spark, "body", f"<article> {long} </article>") == long
    post = f'<div class="my post-content">{"c" * 100}</div>'
    assert field(spark, "body", f"<article>{short}</article>{post}") == "c" * 100
    assert field(spark, "body", f"<article>{'é' * 50}</article>{post}") == "é" * 50
    assert field(spark, "body", f'<main>{long}</main><div id="article-body1">{"i" * 100}</div>') == "i" * 100
    # only the first match of a selector is measured
    assert field(spark, "body", f"<article>x</article><article>{long}</article>") == vocab.NO_BODY
    assert field(spark, "body", f"<article>a<b>b</b> c<script>s</script>{long}</article>").startswith("a b  c s")


def test_body_from_paragraphs(spark):
    p20, p21 = "<p>" + "a" * 20, "<p>" + "b" * 21
    assert field(spark, "body", p21 + p20 + p21) == vocab.NO_BODY  # 43 bytes
    assert field(spark, "body", p21 * 3) == "\n".join(["b" * 21] * 3)
    assert field(spark, "body", "<p>" + "c" * 50) == vocab.NO_BODY
    assert field(spark, "body", "<p> " + "c" * 51 + " <p>short") == "c" * 51


def test_preview_counts_characters(spark):
    text = "\U0001f600" * 600
    row = spark.createDataFrame([(text,)], "b string").select(dom.body_preview(F.col("b"))).first()
    assert row[0] == "\U0001f600" * 500


def visible(spark, html):
    rows = spark.createDataFrame([("u", html)], "url string, html string")
    return dom_ops.parse_pages(rows, ["url"]).select(dom.visible_text(F.col("nodes"))).first()[0]


def test_visible_text_repeats_nested_elements(spark):
    html = "<div>none</div><ul><li>outer<p>inner</p></li></ul><h1>abc</h1><td>cell</td><p>éé</p>"
    assert visible(spark, html) == "outer inner inner éé"
    table = "<table><tr><td>cell</td><th>head</th></tr></table><blockquote> quote </blockquote>"
    assert visible(spark, table) == "cell head quote"


def test_selectors(spark):
    html = '<p class="ab" id="x">1</p><div class="bc" data-v="Q">2</div><h2 id="x">3</h2>'
    parsed = dom_ops.parse_pages(spark.createDataFrame([("u", html)], "url string, html string"), ["url"])

    def tags(selector):
        return [r.tag for r in dom_ops.dom_select(parsed, ["url"], selector).collect()]

    assert tags(dom.tag_is("h2")) == ["h2"]
    assert tags(dom.tag_is("p", "h2")) == ["p", "h2"]
    assert tags(dom.has_attr("data-v")) == ["div"]
    assert tags(dom.attr_is("id", "x")) == ["p", "h2"]
    assert tags(dom.attr_is("id", "x", tag="h2")) == ["h2"]
    assert tags(dom.attr_contains("class", "b")) == ["p", "div"]
    assert tags(dom.attr_contains("class", "B")) == []


def test_dom_nodes_and_preprocess(spark, pages):
    table = pages({"u": "<p>Elections, elections</p>", "v": "", "w": None})
    nodes = dom_ops.dom_nodes(table, ["url"])
    assert {(r.url, r.node_id, r.tag) for r in nodes.collect()} == {("u", 0, "p"), ("u", 1, None)}
    counts = dom_ops.preprocess(table, ["url"])
    assert [(r.url, r.term, r.tf) for r in counts.collect()] == [("u", "election", 2)]
