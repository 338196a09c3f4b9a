"""HTML -> flat node array, the one place that needs Python.

``parse_html`` is a tolerant parser in the spirit of the public HTML standard:
tags, attributes, character references, void elements, raw text, implied end
tags.  It aims at text order and ancestry, which is what the extraction reads.
Left out: rebuilding of formatting elements across blocks, foster parenting in
tables, foreign-content name fixing, script escape states.

Nodes come in document order and a node's position is its id; the descendants of
element e are exactly the nodes ``e.node_id + 1 .. e.end_id``.
"""

import html as _html
import re
import sys
from collections.abc import Iterator
from html.entities import html5 as _ENTITIES

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.functions.batches import parts

NODES = T.ArrayType(
    T.StructType()
    .add("node_id", T.IntegerType())
    .add("end_id", T.IntegerType())
    .add("parent_id", T.IntegerType())
    .add("tag", T.StringType())
    .add("attrs", T.MapType(T.StringType(), T.StringType()))
    .add("text", T.StringType())
)

# ---------------------------------------------------------------------------
# Element categories of the HTML standard.
# ---------------------------------------------------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
RAW_WITH_REFERENCES = frozenset(("title", "textarea"))
HEAD_CONTENT = frozenset(
    "base basefont bgsound link meta noframes noscript script style template title".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset(
    "a b big code em font i nobr s small strike strong tt u".split()
)
SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption
    center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form
    frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link
    listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre
    script search section select source style summary table tbody td template textarea tfoot th
    thead title tr track ul wbr xmp""".split()
)
ENDS_PARAGRAPH = frozenset(
    """address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext
    pre search section summary table ul xmp""".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
# what shields an open element from being ended by an inner tag
PARAGRAPH_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
ITEM_SCOPE = SPECIAL - {"address", "div", "p"}
TABLE_SCOPE = frozenset(("table", "template"))
# start tag -> (open elements it ends, elements that shield them)
IMPLIED_END = {
    "li": (frozenset(("li",)), ITEM_SCOPE),
    "dd": (frozenset(("dd", "dt")), ITEM_SCOPE),
    "dt": (frozenset(("dd", "dt")), ITEM_SCOPE),
    "td": (frozenset(("td", "th")), TABLE_SCOPE),
    "th": (frozenset(("td", "th")), TABLE_SCOPE),
    "tr": (frozenset(("tr",)), TABLE_SCOPE),
    "option": (frozenset(("option",)), SPECIAL),
    "optgroup": (frozenset(("option", "optgroup")), SPECIAL),
    "button": (frozenset(("button",)), SCOPE),
    "a": (frozenset(("a",)), SCOPE),
}
for _tag in ("tbody", "thead", "tfoot", "caption", "colgroup"):
    IMPLIED_END[_tag] = (frozenset(("tbody", "thead", "tfoot", "caption", "colgroup", "tr")), TABLE_SCOPE)
TABLE_PARTS = frozenset("tbody thead tfoot caption colgroup col tr td th".split())
_SHIELDS = (SCOPE, PARAGRAPH_SCOPE, LIST_SCOPE, ITEM_SCOPE, TABLE_SCOPE, SPECIAL)
# tag -> the shields it belongs to
_SHIELDS_OF = {tag: [shield for shield in _SHIELDS if tag in shield] for tag in SPECIAL}

_S = r"[\t\n\f\r ]"
_NAME = r"[^\t\n\f\r />][^\t\n\f\r />=]*+"
_ATTR = rf"""{_NAME}(?:{_S}*+={_S}*+(?:"[^"]*+"?|'[^']*+'?|[^\t\n\f\r >"'][^\t\n\f\r >]*+)?+)?+"""
_MARKUP = re.compile(
    rf"<(?:(!--(?:-?>|.*?(?:--!?>|\Z)))|[!?][^>]*+>?|/(?![a-zA-Z])(?!\Z)[^>]*+>?"
    rf"|(/?)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_ATTR})*+)(>?))",
    re.S,
)
_ATTR_PARTS = re.compile(
    rf"""({_NAME})(?:{_S}*+={_S}*+(?:"([^"]*+)"?|'([^']*+)'?|([^\t\n\f\r >"'][^\t\n\f\r >]*+))?+)?+"""
)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW_TEXT}
_REFERENCE = re.compile(r"&(#\d+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*(;|=)?)")


def _decode_attr(value):
    """Attribute values keep ``&name`` as is unless it is a whole known name."""

    def decode(match):
        if match[1][0] == "#":
            return _html.unescape(match[0])
        return _ENTITIES.get(match[1], match[0])

    return _REFERENCE.sub(decode, value) if "&" in value else value


class _Tree:
    """Node columns under construction plus the stack of open elements.

    Node ids grow along the stack, so "the innermost open p is not shielded" compares
    two ids: the last open p and the last open shield.  Each element is pushed and
    popped once, whatever the nesting depth.
    """

    def __init__(self):
        self.ends, self.parents, self.tags, self.attrs, self.texts = [], [], [], [], []
        self.open = []  # (tag, node id)
        self.ended = set()  # formatting elements that ended below open blocks
        self.by_tag = {}  # tag -> ids of its open elements
        self.by_shield = {shield: [-1] for shield in _SHIELDS}
        self.fresh_text = True  # the next text must not join the previous node
        self.more_text = []  # what joins the last text node

    def node(self, tag, attrs, text):
        self.join_text()
        self.ends.append(len(self.tags))
        self.parents.append(self.open[-1][1] if self.open else -1)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.texts.append(text)
        self.fresh_text = tag is not None

    def join_text(self):
        if self.more_text:
            self.texts[-1] += "".join(self.more_text)
            self.more_text = []

    def push(self, tag, node_id):
        self.open.append((tag, node_id))
        self.by_tag.setdefault(tag, []).append(node_id)
        for shield in _SHIELDS_OF.get(tag, ()):
            self.by_shield[shield].append(node_id)

    def close_from(self, node_id):
        """Close this open element and all inside it."""
        last = len(self.tags) - 1
        while self.open and (self.open[-1][1] >= node_id or self.open[-1][1] in self.ended):
            tag, top = self.open.pop()
            if top in self.ended:
                self.ended.remove(top)
                continue
            self.ends[top] = last
            self.by_tag[tag].pop()
            for shield in _SHIELDS_OF.get(tag, ()):
                self.by_shield[shield].pop()

    def innermost(self, tag):
        ids = self.by_tag.get(tag)
        return ids[-1] if ids else -1

    def close(self, tags, shields):
        """Close the innermost open element of ``tags`` unless shielded."""
        found = max(map(self.innermost, tags))
        if found < 0 or found < self.by_shield[shields][-1]:
            return False
        self.close_from(found)
        return True

    def is_open(self, tag):
        return bool(self.by_tag.get(tag))

    def text(self, text):
        top = self.open[-1][0] if self.open else None
        if top in (None, "html", "head") and not text.strip("\t\n\f\r "):
            return
        if top == "head":
            self.close_from(self.open[-1][1])
        if self.tags and self.tags[-1] in ("pre", "listing", "textarea") and text[0] == "\n":
            text = text[1:]
        parent = self.open[-1][1] if self.open else -1
        if not self.fresh_text and self.parents[-1] == parent:
            self.more_text.append(text)
        elif text:
            self.node(None, None, text)

    def start(self, tag, attrs, self_closed):
        if tag in ("html", "head", "body") and self.is_open(tag):
            return
        if tag in TABLE_PARTS and not self.is_open("table"):
            return
        if self.open and self.open[-1][0] == "head" and tag not in HEAD_CONTENT:
            self.close_from(self.open[-1][1])
        if tag in ENDS_PARAGRAPH:
            self.close(("p",), PARAGRAPH_SCOPE)
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.close_from(self.open[-1][1])
        if tag in IMPLIED_END:
            self.close(*IMPLIED_END[tag])
        self.node(tag, attrs, None)
        foreign = self_closed and (self.is_open("svg") or self.is_open("math") or tag in ("svg", "math"))
        if tag not in VOID and not foreign:
            self.push(tag, len(self.tags) - 1)

    def end(self, tag):
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.node("br", None, None)
        elif tag == "p":
            if not self.close(("p",), PARAGRAPH_SCOPE):
                self.node("p", None, None)
        elif tag in HEADINGS:
            self.close(HEADINGS, SCOPE)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag == "li":
            self.close(("li",), LIST_SCOPE)
        elif tag in TABLE_PARTS or tag == "table":
            self.close((tag,), TABLE_SCOPE)
        elif tag in SPECIAL:
            self.close((tag,), SCOPE)
        else:
            self.close((tag,), SPECIAL)

    def end_formatting(self, tag):
        """End a formatting element; blocks opened inside it stay open."""
        found = self.innermost(tag)
        if found < 0 or found < self.by_shield[SCOPE][-1]:
            return
        if found < self.by_shield[SPECIAL][-1]:
            self.ends[found] = len(self.tags) - 1
            self.by_tag[tag].pop()
            self.ended.add(found)
            self.fresh_text = True
        else:
            self.close_from(found)


def parse_html(html):
    """Parse one page; returns a ``_Tree`` whose lists are the node columns."""
    tree = _Tree()
    html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "").removeprefix("\ufeff")
    pos, end = 0, len(html)
    while pos < end:
        match = _MARKUP.search(html, pos)
        stop = match.start() if match else end
        if stop > pos:
            tree.text(_html.unescape(html[pos:stop]))
        if not match:
            break
        pos = match.end()
        comment, slash, tag, attrs, closed = match.groups()
        if tag is None:
            if comment or match[0][1] == "?":
                tree.fresh_text = True
            continue
        if not closed:  # the page ends inside this tag
            break
        tag = tag.lower()
        if slash:
            tree.end(tag)
            continue
        parsed = None
        if attrs and not attrs.isspace():
            parsed = {}
            for name, double, single, bare in _ATTR_PARTS.findall(attrs):
                parsed.setdefault(name.lower(), _decode_attr(double or single or bare))
        tree.start(tag, parsed, attrs.endswith("/"))
        if tag in RAW_TEXT:
            raw_end = _RAW_END[tag].search(html, pos)
            stop = raw_end.start() if raw_end else end
            if stop > pos:
                raw = html[pos:stop]
                tree.text(_html.unescape(raw) if tag in RAW_WITH_REFERENCES else raw)
            pos = stop
    tree.close_from(0)
    tree.join_text()
    return tree


def _parse_batch(pages: pa.Array) -> pa.Array:
    """Arrow in, Arrow out: node columns are built flat, never row by row."""
    offsets, ids = [0], []
    ends, parents, tags, texts = [], [], [], []
    attr_offsets, keys, values = [0], [], []
    for page in pages:
        html = page.as_py()
        if html is None:
            offsets.append(len(ids))
            continue
        tree = parse_html(html)
        ids.extend(range(len(tree.tags)))
        ends.extend(tree.ends)
        parents.extend(tree.parents)
        tags.extend(tree.tags)
        texts.extend(tree.texts)
        for attrs in tree.attrs:
            if attrs:
                keys.extend(attrs.keys())
                values.extend(attrs.values())
            attr_offsets.append(len(keys))
        offsets.append(len(ids))
    string = pa.string()
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_offsets, pa.int32()), pa.array(keys, string), pa.array(values, string)
    )
    nodes = pa.StructArray.from_arrays(
        [
            pa.array(ids, pa.int32()), pa.array(ends, pa.int32()), pa.array(parents, pa.int32()),
            pa.array(tags, string), attrs, pa.array(texts, string),
        ],
        names=["node_id", "end_id", "parent_id", "tag", "attrs", "text"],
    )
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes)


def _parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Nodes are many times the size of their page: those of one part are held at a time."""
    for batch in batches:
        for pages in parts(batch):
            yield _parse_batch(pages)


# Ship this helper with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_parse = F.arrow_udf(_parse_batches, NODES)


def html_nodes(html):
    """Column of HTML text -> ``array<struct<node_id, end_id, parent_id, tag, attrs, text>>``."""
    return _parse(html)
