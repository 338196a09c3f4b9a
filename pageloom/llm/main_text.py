"""Main text of HTML pages by scoring the element tree.

Every paragraph gives points for its length and its commas to the containers above
it, less with distance; a container's sum is discounted by the share of its text that
stands in links.  The best container is kept, with siblings that score well enough.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by their element, role, class or id before scoring.  A class or
id alone leaves nothing out that holds the page's article or main part.

A page is parsed in one pass; the work is linear in its length, whatever its nesting.

Edge cases: a null, empty or textless page has an empty text; repeated rows are treated
one by one; an empty table gives an empty result; only the columns named here are read.
"""

import html as _html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from pageloom.llm.shared import per_batch

# Element names and the words of classes, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
LEFT_OUT = frozenset("head nav footer aside form button fieldset menu dialog option optgroup datalist applet annotation annotation-xml "
    "noscript template svg canvas video audio select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter nobr object output progress q rb rp rt rtc "
    "ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msup msub msubsup mover munder munderover annotation annotation-xml".split()
)
PARAGRAPHS = frozenset("p pre li dd dt blockquote td th caption figcaption summary address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
LISTS = frozenset("ul ol dl table div section".split())
IMPLIED = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",)}
SCOPES = tuple("ul ol dl table td th tr article section main body button div blockquote".split())
CELLS = ("td", "th", "button", "caption")
FLOW = PARAGRAPHS | HEADINGS | frozenset("ul ol dl table section figure".split())
FRAME = frozenset("nav header footer aside menu".split())
FRAME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:sidebar|side|aside|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|foot|header|masthead|topbar|"
    r"comments?|commentlist|disqus\w*|respond|replies|related|recommend\w*|pagination|pager)(?:$|[\s_-])", re.I)
# Start tags that end an svg element that was left open.
BREAKS_SVG = FLOW - frozenset("caption td th".split()) | frozenset(
    "article main div body br center em embed head hr i img menu nobr s small span strike strong sub sup tt u b big code var".split())
NEVER_LEFT_OUT = frozenset(("html", "body", "article", "main"))
UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|side|aside|nav|navbar|navigation|menu\w*|"
    r"breadcrumbs?|footer|foot|header|masthead|topbar|comments?|commentlist|disqus\w*|respond|replies|reply|cookies?|notices?|"
    r"consent|gdpr|alert|popup|modal|overlay|subscribe|subscription|newsletter|share|sharing|social|related|recommend\w*|"
    r"widget\w*|pagination|pager|login|signup|signin|toolbar|skip|hidden|disclaimer|outbrain|taboola)(?:$|[\s_-])", re.I)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|articlebody|content|main|post|entry|story|text|body|page|blog)(?:$|[\s_-])", re.I)
ALWAYS_UNWANTED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|comments?|commentlist|disqus\w*|cookies?|sidebar|navbar|menu|footer|"
    r"newsletter|related|share|social|breadcrumbs?)(?:$|[\s_-])", re.I)
READERS = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|disqus\w*|respond|replies|reply|related|recommend\w*)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?:no|has|with|without)[_-]", re.I)
WRAP = re.compile(r"[_-]wrap(?:per)?$", re.I)
UNWANTED_ROLES = frozenset(
    "navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar form status note".split()
)
_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^>\s]*+))*+)>")
_LETTER = re.compile("[a-zA-Z]")
_ATTR = re.compile(r"([^\s/=>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# What a container gets of a paragraph inside it: the whole, a half, and so on upwards.
_SHARES = (1, 2, 6, 9, 12)
_SIBLING_SHARE = 0.2
_LINKED = 0.5
# A menu: this share of its text in links, of so few characters on average.
_MENU, _LABEL = 0.9, 25
# About one paragraph of running text.
_WORTH = 2.0


class _Page:
    """Element columns and text blocks of one page; element 0 stands for the page."""

    def __init__(self):
        self.parent, self.tag, self.out, self.bonus = [-1], ["body"], [False], [0.0]
        self.frame: set[int] = set()  # left-out elements that stand around articles, not in them
        self.whole: set[int] = set()  # elements marked as the article or main part
        self.loose: dict[int, bool] = {}  # left out by class or id unless they hold the article; True: readers' part
        self.owner, self.holder = [0], [0]  # nearest block, and nearest possible container, at or above
        self.stack = [0]
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements of a name
        self.blocks = [0]  # places in the stack of what is no inline element
        self.links = 0
        self.chunks: list[tuple[int, int, bool, str]] = []  # block, element, in a link, text
        self.block = 0

    def start(self, tag: str, attrs: str) -> None:
        if self.open.get("svg") and not self.open.get("foreignobject"):
            if tag in BREAKS_SVG:
                self.end("svg")
            elif attrs.endswith("/"):
                return
        if tag not in INLINE:
            self.block += 1
            if self.open.get("p") and self.open["p"][-1] > self._innermost(CELLS):
                self.end("p")
        if tag in IMPLIED:
            while (depth := self._innermost(IMPLIED[tag])) and depth >= self._innermost(SCOPES):
                self._pop_to(depth)
        if tag in VOID:
            return
        above = self.stack[-1]
        out = self.out[above]
        bonus = 0.0
        if not out:
            out, bonus = self._judge(tag, attrs, len(self.tag))
        self.parent.append(above)
        self.tag.append(tag)
        self.out.append(out)
        self.bonus.append(bonus)
        number, depth = len(self.tag) - 1, len(self.stack)
        self.owner.append(self.owner[above] if tag in INLINE else number)
        self.holder.append(number if _holds(tag) else self.holder[above])
        self.stack.append(number)
        self.open.setdefault(tag, []).append(depth)
        if tag not in INLINE:
            self.blocks.append(depth)
        self.links += tag == "a"

    def _judge(self, tag: str, attrs: str, number: int) -> tuple[bool, float]:
        """Whether the element is left out, and its head start."""
        bonus = 25.0 if tag in ("article", "main") else 0.0
        if bonus:
            self.whole.add(number)
        if tag in LEFT_OUT and not (
            tag == "dialog" and re.search(r"\sopen\b", attrs, re.I) and (self.open.get("article") or self.open.get("main"))
        ) or tag == "header" and not (self.open.get("article") or self.open.get("main")):
            if tag in FRAME:
                self.frame.add(number)
            return True, 0.0
        if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
            return False, bonus
        found = {}
        for name, double, single, bare in _ATTR.findall(attrs):
            found.setdefault(name.lower(), double or single or bare)
        name = f"{found.get('class', '')} {found.get('id', '')}"
        wanted = WANTED.search(name) is not None
        if tag not in NEVER_LEFT_OUT:
            if "hidden" in found or found.get("aria-hidden") == "true":
                return True, 0.0
            if found.get("role", "").lower() in UNWANTED_ROLES:
                self.frame.add(number)
                return True, 0.0
            if "display:none" in found.get("style", "").replace(" ", "").lower():
                return True, 0.0
            if tag not in HEADINGS and UNWANTED.search(name):
                readers = _unwanted(name)
                if readers is not None:
                    if FRAME_NAMES.search(name):
                        self.frame.add(number)
                    if tag in INLINE:
                        return True, 0.0
                    self.loose[number] = readers
        if found.get("itemprop") == "articleBody" or found.get("role") == "main":
            bonus += 25.0
            self.whole.add(number)
        return False, bonus + 10.0 * wanted

    def _innermost(self, names: tuple[str, ...]) -> int:
        """Place in the stack of the innermost open element with one of the names, 0 if there is none."""
        return max([self.open[name][-1] for name in names if self.open.get(name)], default=0)

    def _pop_to(self, depth: int) -> None:
        for element in self.stack[depth:]:
            name = self.tag[element]
            self.open[name].pop()
            self.links -= name == "a"
        del self.stack[depth:]
        while self.blocks[-1] >= depth:
            self.blocks.pop()

    def end(self, tag: str) -> None:
        if tag not in INLINE:
            self.block += 1
        if not self.open.get(tag):
            return
        depth = self.open[tag][-1]
        if tag in INLINE and self.blocks[-1] > depth:
            return  # an inline end tag does not close the blocks inside it
        self._pop_to(depth)

    def text(self, text: str) -> None:
        element = self.stack[-1]
        if not self.out[element] and text:
            self.chunks.append((self.block, element, self.links > 0, text))


def _unwanted(name: str) -> bool | None:
    """None if classes and id do not speak against an element, else whether they name its readers' part."""
    words = [
        word for word in name.split()
        if not LAYOUT.match(word) and not (WRAP.search(word) and WANTED.search(word) and not READERS.search(word))
    ]
    left = " ".join(words)
    if not ALWAYS_UNWANTED.search(left) and (WANTED.search(left) or not UNWANTED.search(left)):
        return None
    return READERS.search(left) is not None and not any(WANTED.search(w) and not UNWANTED.search(w) for w in words)


def parse(html: str) -> _Page:
    page, pos, size = _Page(), 0, len(html)
    while pos < size:
        at = html.find("<", pos)
        if at < 0:
            page.text(html[pos:])
            break
        if at > pos:
            page.text(html[pos:at])
        following = html[at + 1:at + 2]
        if following == "!" or following == "?":
            if html.startswith("<!--", at):
                closing = html.find("-->", at + 2)  # <!--> is a whole comment
                pos = size if closing < 0 else closing + 3
            else:
                closing = html.find(">", at)
                pos = size if closing < 0 else closing + 1
            continue
        match = _TAG.match(html, at)
        if match is None:
            letter = html[at + 2:at + 3] if following == "/" else following
            if following == "/" and not _LETTER.match(letter):
                closing = html.find(">", at + 2)  # what no end tag can be is a comment
                pos = size if closing < 0 else closing + 1
                continue
            if _LETTER.match(letter):
                break  # the page ends inside a tag
            page.text("<")
            pos = at + 1
            continue
        slash, tag, attrs = match.groups()
        tag, pos = tag.lower(), match.end()
        if slash:
            page.end(tag)
        elif tag == "br" or tag == "hr":
            page.text(" ")
        elif tag in RAW and not attrs.endswith("/"):
            closing = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, pos)
            stop = html.find(">", closing.end()) if closing else -1
            pos = size if stop < 0 else stop + 1
        else:
            page.start(tag, attrs)
    return page


def _blocks(page: _Page) -> list[tuple[int, str, int]]:
    """(element, text, characters in links) of every block with text, in page order."""
    blocks, at = [], 0
    chunks = page.chunks
    while at < len(chunks):
        number, first = chunks[at][0], chunks[at][1]
        parts, linked = [], 0
        while at < len(chunks) and chunks[at][0] == number:
            text = chunks[at][3]
            text = _html.unescape(text) if "&" in text else text
            parts.append(text)
            linked += len(text.strip()) if chunks[at][2] else 0
            at += 1
        text = " ".join("".join(parts).split())
        if text:
            blocks.append((page.owner[first], text, linked))
    return blocks


def main_text(html: str) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    page = parse(html)
    blocks = _blocks(page)
    if not blocks:
        return ""
    n = len(page.tag)
    gains = [_gain(page.tag[element], text, in_links) for element, text, in_links in blocks]
    if page.loose:
        _settle(page, blocks, gains)
        gains = [gain for gain, (element, _, _) in zip(gains, blocks) if not page.out[element]]
        blocks = [block for block in blocks if not page.out[block[0]]]
    points, length, linked = [0.0] * n, [0] * n, [0] * n
    for (element, text, in_links), gain in zip(blocks, gains):
        length[element] += len(text)
        linked[element] += in_links
        if not gain:
            continue
        holder = page.holder[element]
        for share in _SHARES:
            points[holder] += gain / share
            if holder == 0:
                break
            holder = page.holder[page.parent[holder]]
    for element in range(n - 1, 0, -1):
        length[page.parent[element]] += length[element]
        linked[page.parent[element]] += linked[element]
    score = [0.0] * n
    for element in range(n):
        if points[element] > 0 or page.bonus[element] and length[element]:
            density = min(1.0, linked[element] / max(1, length[element]))
            score[element] = (points[element] + page.bonus[element]) * (1 - density)
    best = max(range(n), key=lambda e: (score[e], -e))
    top = _article(page, best, length, linked)
    kept = {top}
    limit = max(10.0, _SIBLING_SHARE * score[best])
    for element in range(1, n):
        if page.parent[element] == page.parent[top] and element != top and not page.out[element]:
            tag, density = page.tag[element], linked[element] / max(1, length[element])
            if score[element] >= limit or tag == "h1" and element < top or (
                tag == "p" and density < 0.25 and length[element] >= 80
            ) or top not in page.whole and density <= _LINKED and (tag in FLOW or points[element] >= _WORTH):
                kept.add(element)
    menus = _menus(page, top, length, linked)
    inside = [False] * n
    for element in range(n):
        above = page.parent[element]
        inside[element] = element in kept or above >= 0 and inside[above] and element not in menus
    return " ".join(text for element, text, _ in blocks if inside[element])


def _gain(tag: str, text: str, in_links: int) -> float:
    """Points of a block: its length and commas, less what stands in links; none for headings."""
    if tag in HEADINGS:
        return 0.0
    gain = min(1.0, len(text) / 25) + text.count(",") + min(3.0, len(text) / 100)
    return gain * (1 - min(1.0, in_links / len(text)))


def _settle(page: _Page, blocks: list[tuple[int, str, int]], gains: list[float]) -> None:
    """Leave out what its class or id speaks against, unless it holds the article.

    It does if it contains a main part, the page's largest article, or, where no such
    element stands elsewhere, most of the points of paragraphs.  Of the readers' part
    (comments, related pages) only the first counts.
    """
    n = len(page.tag)
    size, every, own = [0] * n, [0.0] * n, [0.0] * n
    for (element, text, _), gain in zip(blocks, gains):
        size[element] += len(text)
        every[element] += gain
        own[element] += gain if page.tag[element] in PARAGRAPHS else 0.0
    readers, loose = [False] * n, [False] * n
    for element in range(1, n):
        above = page.parent[element]
        readers[element] = readers[above] or page.loose.get(element, False)
        loose[element] = loose[above] or element in page.loose
    total = sum(gain for gain, out in zip(every, readers) if not out)
    paragraphs = sum(gain for gain, out in zip(own, readers) if not out)
    below, main = own[:], [False] * n
    for element in range(n - 1, 0, -1):
        above = page.parent[element]
        size[above] += size[element]
        every[above] += every[element]
        below[above] += below[element]
        main[above] |= main[element] or element in page.whole and page.tag[element] != "article" and size[element] > 0
    marked = [e for e in page.whole if size[e] and not readers[e] and not page.out[e]]
    elsewhere = any(not loose[e] for e in marked)
    article = max((e for e in marked if page.tag[e] == "article"), key=lambda e: (size[e], -e), default=0)
    around = set()
    if article and every[article] >= _SIBLING_SHARE * total:
        while article > 0:
            around.add(article)
            article = page.parent[article]
    for element in range(1, n):
        if page.out[page.parent[element]]:
            page.out[element] = True
        elif element in page.loose:
            page.out[element] = not (main[element] or not readers[element] and (
                element in around or not elsewhere and 2 * (below[element] - own[element]) > paragraphs))
            if not page.out[element]:
                page.frame.discard(element)


def _article(page: _Page, best: int, length: list[int], linked: list[int]) -> int:
    """The element that holds the whole article of which ``best`` is the best container.

    It is the outermost article around ``best`` inside the nearest main element, else
    that main element or another one marked as main part.  From an unmarked element,
    and from an article inside main, it goes on to the parent as long as nothing
    beside it is link-dense or part of the page's frame.
    """
    chain = [best]
    while page.parent[chain[-1]] >= 0:
        chain.append(page.parent[chain[-1]])
    on_chain = set(chain)
    blocked = set()
    for element in range(1, len(page.tag)):
        above = page.parent[element]
        if above in on_chain and element not in on_chain and (
            element in page.frame or length[element] and linked[element] > _LINKED * length[element]
        ):
            blocked.add(above)
    main = next((at for at, element in enumerate(chain) if page.tag[element] == "main"), None)
    marked = [at for at, element in enumerate(chain) if element in page.whole and (main is None or at < main)]
    articles = [at for at in marked if page.tag[chain[at]] == "article"]
    at, last = 0, len(chain) - 1
    if marked or main is not None:
        at = (articles or marked[-1:] or [main])[-1]
        last = at if main is None else main
    while at < last and chain[at + 1] not in blocked:
        at += 1
    return chain[at]


def _holds(tag: str) -> bool:
    """Whether an element can be the container of an article."""
    return tag not in PARAGRAPHS and tag not in HEADINGS and tag not in ("ul", "ol", "dl", "tr", "tbody", "thead", "tfoot")


def _menus(page: _Page, top: int, length: list[int], linked: list[int]) -> set[int]:
    """Lists and boxes of short links; none inside a marked article and none right after a heading."""
    above = top
    while above >= 0:
        if page.bonus[above] and page.tag[above] not in ("html", "body"):
            return set()
        above = page.parent[above]
    n = len(page.tag)
    links, before, menus = [0] * n, [0] * n, set()
    for element in range(n - 1, 0, -1):
        links[element] += page.tag[element] == "a"
        links[page.parent[element]] += links[element]
    for element in range(1, n):
        above = page.parent[element]
        if not length[element] or page.tag[element] in INLINE:
            continue
        if page.tag[element] in LISTS and linked[element] >= _MENU * length[element] and (
            linked[element] < _LABEL * links[element] and page.tag[before[above]] not in HEADINGS
        ):
            menus.add(element)
        before[above] = element
    return menus


def _extract(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = [main_text(value.as_py() or "") for value in batch.column("html")]
    yield pa.RecordBatch.from_arrays(
        [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
         pa.array([len(text) for text in texts], pa.int64())],
        ["page_id", "url", "text", "n_chars"],
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page."""
    kept = pages.select(pages["page_id"].cast("long"), "url", "html")
    return kept.mapInArrow(per_batch(_extract), "page_id long, url string, text string, n_chars long")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
