"""HTML extraction and WARC archives, and the pipeline against brute force."""

import base64
import hashlib
import html.parser
import pathlib
import re
import time

import pytest

from pageloom.llm import catalog, main_text, warc

PARAGRAPH = "A paragraph of the article, with commas, words, and enough length to count as text."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div class="cookie-notice">We use cookies, really.</div><div id="content"><h1>Head&shy;line &amp; more</h1>
<p>{PARAGRAPH}<p>Second<br>line&nbsp;with <b>bold</b>ness and <a href=x>a link</a>, {PARAGRAPH}
<script>if (a < b) document.write("</p>")</script><!-- <p>hidden --><ul><li>First, item <li>Second item</ul>
<form>Name <input></form><aside>Side note, long enough to be taken for text by its commas, too.</aside></div>
<section id="comments"><p>Great post, thank you, all, really, very, very good, and long, too, indeed.</p></section>
<div class="ad">Buy, buy, buy, buy, buy, buy now, everything, must, go, today.</div><footer>&copy; 2024</footer></body></html>"""
WANT = (f"Head\xadline & more {PARAGRAPH} Second line with boldness and a link, {PARAGRAPH} First, item Second item")


def test_article_of_a_page():
    assert main_text.main_text(PAGE) == WANT


@pytest.mark.parametrize(("html", "want"), [
    ("", ""), ("plain words", "plain words"), ("<p>a", "a"), ("<p>a < b</p>", "a < b"), ("<script>x", ""),
    ("<article><h1>T</h1></article><footer>f</footer>", "T"), ("<div hidden>x</div><p>y", "y"),
    ("<p>one</p>two<p>three", "one two three"), ("a<b>b</b>c", "abc"), ("<p>x<!-- y", "x"), ("<p a='>'>x", "x"),
    ("<table><tr><td>a<td>b</table>", "a b"), ("&#x41;&eacute;&nosuch;", "Aé&nosuch;"),
])
def test_small_pages(html, want):
    assert main_text.main_text(html) == want


@pytest.mark.parametrize("unit", ["<div>", "<ul><li>", "<b><p>", "<table><tr><td>", "<a>", "</div>", "<", "<p class='x",
                                  "<ul><li>x", "<b>x<p></p>", "<p><b>x<td>", "<dl><dt><i>x", "<label>x<div>"])
def test_nesting_is_linear(unit):
    start = time.process_time()
    main_text.main_text(unit * 100_000 + "text")
    assert time.process_time() - start < 6


@pytest.mark.parametrize(("before", "after"), [("<b>", "</b>"), ("<p><td>", "<div>"), ("<li>", "<li>"), ("<b>", "x<div></b>")])
def test_end_tags_over_deep_nesting_are_linear(before, after):
    start = time.process_time()
    main_text.main_text(before + "<div>" * 100_000 + after * 100_000 + "text")
    main_text.main_text(before + "<i>" * 100_000 + after * 100_000 + "text")
    assert time.process_time() - start < 12


@pytest.mark.parametrize("depth", [1, 8, 9, 300])
def test_no_depth_changes_the_tree(depth):
    inline = "<i>" * depth
    assert main_text.main_text(f"<ul><li>a{inline}b<li>c</ul><p>d") == "ab c d"
    blocks = "<div>" * depth
    assert main_text.main_text(f"<div><b>a{blocks}b</b>c{'</div>' * depth}</div><p>d") == "a bc d"


def test_texts_of_labels_objects_and_maps_stay():
    page = "<article><p>One <label>two</label><object>three</object><map>four</map></p><form><label>Name</label></form></article>"
    assert main_text.main_text(page) == "One twothreefour"


class _Reader(html.parser.HTMLParser):
    """The words inside ``article``, without what is marked as an advert."""

    def __init__(self):
        super().__init__()
        self.inside, self.advert, self.words = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if self.advert or "ad" in (dict(attrs).get("class") or "").split():
            self.advert += tag not in main_text.VOID

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.advert -= self.advert > 0

    def handle_data(self, data):
        if self.inside and not self.advert:
            self.words += data.split()


def test_pages_of_the_table_against_a_plain_reader(spark):
    folder = "/root/testdata/sf0.01"
    if not pathlib.Path(folder).exists():
        pytest.skip("needs the test tables")
    pages = {row.page_id: row.html for row in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    found = catalog.QUERIES["op1_main_text"](spark, folder).collect()
    assert len(found) == len(pages)
    for row in found:
        reader = _Reader()
        reader.feed(pages[row.page_id] or "")
        assert row.text.split() == reader.words and row.n_chars == len(row.text)


LONG, SHORT = f"<section><h2>Long</h2>{f'<p>{PARAGRAPH}</p>' * 30}</section>", f"<section><h2>End</h2><p>{PARAGRAPH}</p><p>Yes.</p></section>"
PARTS = f"<h1>Title</h1><p>Lead.</p>{LONG}<h3>Points</h3><ul><li>One<li>Two</ul><blockquote>Quote</blockquote>{SHORT}<table><tr><td>Cell</table>"
PARTS_TEXT = f"Title Lead. Long {' '.join([PARAGRAPH] * 30)} Points One Two Quote End {PARAGRAPH} Yes. Cell"


@pytest.mark.parametrize("page", [
    "<nav>Menu</nav><article>{}</article><footer>f</footer>", "<nav>Menu</nav><main>{}</main><div>Beside</div>",
    "<nav>Menu</nav><div><div>{}</div></div><footer>f</footer>", "<nav>Menu</nav>{}<footer>f</footer>", "<div>{}</div>",
    "<main><div>{}</div></main>", "<main><article><div>{}</div></article></main><div>Beside</div>",
])
def test_article_in_sections(page):
    assert main_text.main_text(page.format(PARTS)) == PARTS_TEXT


def test_parts_in_unmarked_boxes():
    parts = PARTS.replace("section>", "div>")
    assert main_text.main_text(f"<div class=menu>Menu</div>{parts}<div>(c) me</div><footer>f</footer>") == PARTS_TEXT


COMMENTS = f"<div id=comments>{f'<article><p>Comment. {PARAGRAPH}</p></article>' * 20}</div>"


@pytest.mark.parametrize("page", [
    '<div class="content-sidebar-wrap"><article>{}</article></div>', '<div id=page class="no-sidebar">{}</div>',
    '<div class="post share-post">{}</div>', '<div class=sidebar-wrap><main>{}</main></div>',
    '<div class=related><div itemprop=articleBody>{}</div></div>', '<div class="post comments-open">{}</div>' + COMMENTS,
    '<div class="sidebar"><article>Teaser</article></div><article>{}</article>' + COMMENTS,
    '<div class=ad><p>' + "Buy, now, " * 90 + '</div><article>{}</article>', '<div class="ad social"><div>{}</div></div>',
])
def test_names_do_not_drop_the_article(page):
    body = f"<h1>T</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class=share><p>Share, this</p></div>"
    assert main_text.main_text(page.format(body)) == f"T {PARAGRAPH} {PARAGRAPH}"


@pytest.mark.parametrize(("html", "want"), [
    ("<figure><img><figcaption>Caption</figcaption></figure>", "Caption"),
    ("<h2>References</h2><ul><li><a>One</a><li><a>Two</a></ul>", "References One Two"),
    ("<table><tr><td><a>Term</a><td>x</table>", "Term x"), ("<dialog open>Said</dialog>", "Said"), ("<dialog>Closed</dialog>", ""),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x</annotation></math>.</p>", "So x=1."),
])
def test_pieces_of_the_article_stay(html, want):
    got = main_text.main_text(f"<nav>Menu</nav><article><p>{PARAGRAPH}</p>{html}</article>")
    assert got == f"{PARAGRAPH} {want}".strip()


def test_lists_of_links_beside_unmarked_text():
    menu = "<ul><li><a>Home</a><li><a>News</a></ul>"
    page = f"<body>{menu}<p>{PARAGRAPH}</p><h2>References</h2>{menu}</body>"
    assert main_text.main_text(page) == f"{PARAGRAPH} References Home News"


@pytest.mark.parametrize(("html", "want"), [
    ("x" + "<" + "/>y", "xy"),
    ("<p>a</><p>b", "a b"), ("<p>a</ div><p>b", "a b"), ("<p>a</3 c><p>b", "a b"), ("<p>a</3", "a"), ("<p>a</p", "a"), ("<p>a<é b", "a<é b"),
    ("<div><select><option>x</div><p>b", "b"), ("<div><video>x</div><p>b", "b"), ("<div><svg><text>x</div><p>b", "b"),
    ("<svg><path d=a /><text>x<p>b", "b"), ("<svg><foreignObject><p>x</p></foreignObject></svg><p>b", "b"),
    ("<div><noscript>x</div><p>b", "b"), ("<div><object>x<p>y</div><p>b", "x y b"), ("<p>a<canvas>x</canvas>b", "a b"),
    ("<p>a<audio>x</audio><p>b<script>x", "a b"), ("<p>a<!--><p>b", "a b"),
])
def test_broken_markup_keeps_the_rest(html, want):
    assert main_text.main_text(html) == want


@pytest.mark.parametrize("unit", ["</3", "</>", "<svg><path/>", "<select>", "<video><p>", "<svg><p>"])
def test_broken_markup_is_linear(unit):
    start = time.process_time()
    main_text.main_text(unit * 100_000 + "text")
    assert time.process_time() - start < 6


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (2, None, ""), (None, "v", PAGE), (3, "w", "<p>" + "word, " * 50_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, main_text.extract_main_text(df).collect()), key=repr)
    want = sorted([(i, u, t, len(t)) for (i, u, _), t in zip(
        rows, ["", "", "", WANT, ("word, " * 50_000).strip()])], key=repr)
    assert got == want


def records(rows):
    first = {}
    for i, html in rows:
        payload = (html or "").encode()
        first[payload] = min([x for x in (first.get(payload), i) if x is not None], default=None)
    return sorted([(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                    "response" if first[(h or "").encode()] == i else "revisit",
                    None if first[(h or "").encode()] == i else first[(h or "").encode()]) for i, h in rows], key=repr)


def test_archives(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 3)
    rows = [(5, "x"), (3, "x"), (9, None), (8, ""), (1, "WARC/1.1\r\n\r\n\r\n\r\nbody"), (2, "é\r\n\r\n"), (4, "x"), (7, "é\r\n\r\n"),
            (6, "long " * 40_000), (None, "x"), (None, "only"), (11, "x\r\n"), (12, "x"), (12, "x")]
    df = spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h, "d") for i, h in rows],
                               "page_id long, url string, html string, payload string").repartition(2)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(tuple, catalog.op9_warc(spark, str(tmp_path)).collect()), key=repr)
    assert got == records(rows)


def test_revisits_carry_no_payload(spark):
    df = spark.createDataFrame([(1, "u", "payload " * 50), (2, "v", "payload " * 50), (3, "w", "tiny"), (4, "w", "tiny")],
                               "page_id long, url string, html string")
    texts = sorted(r.record for r in warc.records(df, min_bytes=100).collect())
    assert sum("payload payload" in t for t in texts) == 1 and sum("WARC-Type: revisit" in t for t in texts) == 1
    assert len({re.search(r"\r\nWARC-Date: (\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ)\r\n", t)[1] for t in texts}) == 1
    assert sum(t.endswith("\r\n\r\ntiny") for t in texts) == 2


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from test_documents import ROWS, plain_secrets, words_of

    from odd_rows import SHARED, documents

    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    bench = [(1, SHARED)]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES)
    assert len(names) == 5
    good = functions[0](spark, docs, sf_dir)
    judged = catalog.op4_quality(spark, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in good.collect()) == sorted(
        (r.doc_id is None, r.doc_id or 0) for r in judged if r.kept)
    for function in functions[:4]:
        assert function(spark, docs, sf_dir).columns == docs.columns
    single = functions[1](spark, docs, sf_dir).collect()
    groups = catalog.op3_simhash(spark, sf_dir).select("fingerprint", "component_id").distinct().collect()
    assert len({r.doc_id for r in single}) == len(single)
    assert {r.doc_id for r in single} == {r.component_id for r in groups}
    clean = functions[2](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in clean} == {i for i, _ in ROWS} - {9, 10, 16}  # those that hold ten words of SHARED in a row
    safe = functions[3](spark, docs, sf_dir).collect()
    assert len(safe) == len(ROWS) and not any(plain_secrets(r.text) for r in safe)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    left = {r.doc_id for r in good.collect()} & {r.doc_id for r in single} - {9, 10, 16}
    assert {r.doc_id for r in rows} <= {r.doc_id for r in good.collect()} - {9, 10, 16} and len(rows) >= len(left)
    assert all(r.n_tokens <= r.bucket_len for r in rows) and words_of("A b") == ["a", "b"]
