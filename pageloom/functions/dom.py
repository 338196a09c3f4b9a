"""Reading a node array: selectors, element text and the fallback chains.

All functions take and return columns and stay inside the page's row.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import words
from pageloom.functions.expr import blank_to_null, built_once, let, trim_space

# ---------------------------------------------------------------------------
# Where the fields of an article are looked for, in order.
# ---------------------------------------------------------------------------
VISIBLE_TAGS = "h1 h2 h3 h4 h5 h6 p li td th blockquote figcaption".split()
BODY_CLASSES = "article-body article__body post-content entry-content story-body content-body".split()
BODY_ID = "article-body"
AUTHOR_CLASSES = ["author", "byline"]
DATE_CLASSES = ["publish", "date", "timestamp"]
MIN_TITLE_BYTES = 5
MAX_AUTHOR_BYTES = 120
MAX_DATE_BYTES = 60
MIN_BODY_BYTES = 100
MIN_PARAGRAPH_BYTES = 21
MIN_PARAGRAPHS_BYTES = 51
MIN_VISIBLE_BYTES = 4
PREVIEW_CHARS = 500

Selector = Callable[[Column], Column]


def tag_is(*tags: str) -> Selector:
    """``tag`` or ``tag, tag``."""
    return lambda node: node["tag"].isin(list(tags))


def has_attr(name: str, tag: str | None = None) -> Selector:
    """``[name]`` or ``tag[name]``."""
    return _with_tag(tag, lambda node: F.element_at(node["attrs"], name).isNotNull())


def attr_is(name: str, value: str, tag: str | None = None) -> Selector:
    """``[name="value"]`` or ``tag[name="value"]``; values are case-sensitive."""
    return _with_tag(tag, lambda node: F.element_at(node["attrs"], name) == value)


def attr_contains(name: str, value: str, tag: str | None = None) -> Selector:
    """``[name*="value"]`` or ``tag[name*="value"]``."""
    return _with_tag(tag, lambda node: F.contains(F.element_at(node["attrs"], name), F.lit(value)))


def _with_tag(tag: str | None, test: Selector) -> Selector:
    return test if tag is None else lambda node: (node["tag"] == tag) & test(node)


def select_nodes(nodes: Column, selector: Selector) -> Column:
    """All matching elements in document order."""
    return F.filter(nodes, selector)


def first_node(nodes: Column, selector: Selector) -> Column:
    return F.get(F.filter(nodes, selector), F.lit(0))


def descendants(nodes: Column, element: Column) -> Column:
    """Nodes below ``element``: a slice, because ids are positions."""
    return F.slice(nodes, element["node_id"] + 2, element["end_id"] - element["node_id"])


def raw_text(nodes: Column, element: Column, separator: str = " ") -> Column:
    """Text nodes below ``element`` joined as they are (elements have null text)."""
    return F.array_join(F.transform(descendants(nodes, element), lambda d: d["text"]), separator)


def text_of(nodes: Column, element: Column) -> Column:
    """Joined and trimmed text of an element; null when there is no element."""
    return F.when(element.isNotNull(), trim_space(raw_text(nodes, element)))


def element_text(nodes: Column, selector: Selector, among: Column | None = None) -> Column:
    """Text of the first match (empty if it has none); null without a match."""
    return let(first_node(nodes if among is None else among, selector), lambda e: text_of(nodes, e))


def first_text(nodes: Column, selector: Selector, among: Column | None = None) -> Column:
    """Text of the first match, empty -> null; a second match is not tried."""
    return blank_to_null(element_text(nodes, selector, among))


def element_text_min(
    nodes: Column, selector: Selector, min_bytes: int, among: Column | None = None
) -> Column:
    """Text of the first match if it has at least ``min_bytes`` bytes."""
    return let(
        element_text(nodes, selector, among),
        lambda text: F.when(F.octet_length(text) >= min_bytes, text),
    )


def _below(text: Column, limit: int) -> Column:
    return let(text, lambda t: F.when(F.octet_length(t) < limit, t))


def meta_content(nodes: Column, selector: Selector) -> Column:
    """Trimmed ``content`` of the first matching meta; missing or empty -> null."""
    content = F.element_at(first_node(nodes, selector)["attrs"], "content")
    return blank_to_null(trim_space(content))


def _metas(nodes: Column) -> Column:
    return F.filter(nodes, tag_is("meta"))


def _with_attr(nodes: Column, name: str) -> Column:
    return F.filter(nodes, has_attr(name))


def title(nodes: Column) -> Column:
    """og:title, first h1 of 5+ bytes, twitter:title, <title>, sentinel."""
    return let(
        _metas(nodes),
        lambda metas: F.coalesce(
            meta_content(metas, attr_is("property", "og:title")),
            element_text_min(nodes, tag_is("h1"), MIN_TITLE_BYTES),
            meta_content(metas, attr_is("name", "twitter:title")),
            first_text(nodes, tag_is("title")),
            F.lit(vocab.NO_TITLE),
        ),
    )


def author(nodes: Column, documented: bool = True) -> Column:
    """Meta author, meta article:author, rel=author, class*=author, class*=byline.

    With ``documented=False`` the steps "meta author" and "rel=author" are left
    out: they are part of the described chain but have no effect in practice.
    """

    def steps(metas: Column, classed: Column) -> Column:
        found = [meta_content(metas, attr_is("name", "article:author"))]
        if documented:
            found.insert(0, meta_content(metas, attr_is("name", "author")))
            rel = lambda n: F.lower(F.element_at(n["attrs"], "rel")) == "author"
            found.append(_below(first_text(nodes, rel), MAX_AUTHOR_BYTES))
        for name in AUTHOR_CLASSES:
            found.append(
                _below(first_text(nodes, attr_contains("class", name), classed), MAX_AUTHOR_BYTES)
            )
        return F.coalesce(*found)

    return let(_metas(nodes), lambda m: let(_with_attr(nodes, "class"), lambda c: steps(m, c)))


def published_date(nodes: Column) -> Column:
    """Raw date string: meta published_time, time[datetime], <time> text, class hints."""
    datetime_attr = F.element_at(
        first_node(nodes, has_attr("datetime", tag="time"))["attrs"], "datetime"
    )
    return let(
        _with_attr(nodes, "class"),
        lambda classed: F.coalesce(
            meta_content(nodes, attr_is("property", "article:published_time", tag="meta")),
            datetime_attr,
            first_text(nodes, tag_is("time")),
            *[
                _below(first_text(nodes, attr_contains("class", name), classed), MAX_DATE_BYTES)
                for name in DATE_CLASSES
            ],
        ),
    )


def paragraphs(nodes: Column) -> Column:
    """All longer <p> texts, one per line; null when that is 50 bytes or less."""
    texts = F.transform(F.filter(nodes, tag_is("p")), lambda p: raw_text(nodes, p))
    longer = F.filter(texts, lambda t: F.octet_length(trim_space(t)) >= MIN_PARAGRAPH_BYTES)
    return let(
        trim_space(F.array_join(longer, "\n")),
        lambda text: F.when(F.octet_length(text) >= MIN_PARAGRAPHS_BYTES, text),
    )


def body(nodes: Column) -> Column:
    """<article>, known body classes and ids, <main>, all paragraphs, sentinel."""

    def steps(classed: Column) -> Column:
        return F.coalesce(
            element_text_min(nodes, tag_is("article"), MIN_BODY_BYTES),
            *[
                element_text_min(nodes, attr_contains("class", name), MIN_BODY_BYTES, classed)
                for name in BODY_CLASSES
            ],
            element_text_min(nodes, attr_contains("id", BODY_ID), MIN_BODY_BYTES),
            element_text_min(nodes, tag_is("main"), MIN_BODY_BYTES),
            paragraphs(nodes),
            F.lit(vocab.NO_BODY),
        )

    return let(_with_attr(nodes, "class"), steps)


def body_preview(body_text: Column) -> Column:
    """First 500 characters (not bytes)."""
    return F.left(body_text, F.lit(PREVIEW_CHARS))


def visible_pieces(nodes: Column) -> Column:
    """Trimmed texts of 4+ bytes below each content element, in document order.

    A text below two nested content elements appears once for each of them.
    """
    pieces = F.transform(
        F.filter(nodes, tag_is(*VISIBLE_TAGS)),
        lambda e: F.transform(descendants(nodes, e), lambda d: trim_space(d["text"])),
    )
    return F.filter(F.flatten(pieces), lambda t: F.octet_length(t) >= MIN_VISIBLE_BYTES)


def visible_text(nodes: Column) -> Column:
    return F.array_join(visible_pieces(nodes), " ")


@built_once
def page_stats(nodes: str, topic_terms: tuple, k: int = vocab.KEYWORDS_PER_PAGE) -> Column:
    """Text stats of the visible text of a node column given by name."""
    return words.text_stats(words.tokens(visible_text(F.col(nodes))), topic_terms, k)


@built_once
def page_field(name: str, nodes: str, documented: bool = True) -> Column:
    """title, author, published_date or body of a node column given by name."""
    if name == "author":
        return author(F.col(nodes), documented)
    return {"title": title, "published_date": published_date, "body": body}[name](F.col(nodes))
