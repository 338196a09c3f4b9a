"""Pieces of DuckDB SQL the oracle statements are put together from."""

from pageloom import vocab
from pageloom.functions import dom

ENTITY_PATTERN = "[A-Z][a-z]{5,}"  # what the catalog's stand-in recogniser finds


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = quoted(vocab.STOP_WORDS)
WORD_BREAK = r"'[^\p{L}\p{N}]+'"


def lemma(w: str) -> str:
    return (
        f"CASE WHEN suffix({w}, 'ing') AND strlen({w}) > 6 THEN left({w}, -3) "
        f"WHEN suffix({w}, 'ed') AND strlen({w}) > 5 THEN left({w}, -2) "
        f"WHEN suffix({w}, 'ies') AND strlen({w}) > 5 THEN left({w}, -3) || 'y' "
        f"WHEN suffix({w}, 's') AND NOT suffix({w}, 'ss') AND strlen({w}) > 4 THEN left({w}, -1) "
        f"ELSE {w} END"
    )


def tokens(text: str) -> str:
    """Ordered token list of a text expression."""
    words = f"list_transform(regexp_split_to_array({text}, {WORD_BREAK}), lambda w: lower(w))"
    kept = f"list_filter({words}, lambda w: strlen(w) >= 3 AND w NOT IN ({STOP}))"
    return f"list_transform({kept}, lambda w: {lemma('w')})"


def term_freq(source: str, keys: str, text: str) -> str:
    return (
        f"SELECT {keys}, term, CAST(count(*) AS BIGINT) AS tf FROM "
        f"(SELECT {keys}, unnest({tokens(text)}) AS term FROM {source}) GROUP BY ALL"
    )


def prefix_hits(term: str, prefixes) -> str:
    tests = " + ".join(f"CAST(starts_with({term}, '{p}') AS INTEGER)" for p in prefixes)
    return f"({tests})"


def relevance(n: str, unique: str, hits: str) -> str:
    n, unique, hits = (f"CAST({x} AS DOUBLE)" for x in (n, unique, hits))
    return (
        f"CASE WHEN {n} = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, "
        f"0.60::DOUBLE * least({hits} / {n}, 1.0::DOUBLE) "
        f"+ 0.25::DOUBLE * sqrt(least({n} / 300.0::DOUBLE, 1.0::DOUBLE)) "
        f"+ 0.15::DOUBLE * least({unique} / {n}, 1.0::DOUBLE)) END"
    )


def category(keywords: str) -> str:
    joined = f"lower(array_to_string({keywords}, ' '))"
    cases = " ".join(
        f"WHEN regexp_matches({joined}, '{'|'.join(signals)}') THEN '{label}'"
        for label, signals in vocab.CATEGORY_RULES
    )
    return f"CASE {cases} ELSE '{vocab.DEFAULT_CATEGORY}' END"


def scores(source: str, keys: str, text: str, prefixes=vocab.TOPIC_TERMS) -> str:
    """``keys, n_tokens, unique_terms, topic_hits, top_keywords (list), relevance, category``."""
    key_list = [k.strip() for k in keys.split(",")]
    using = f"USING ({keys})"
    return f"""
    SELECT *, {category('top_keywords')} AS category,
           {relevance('n_tokens', 'unique_terms', 'topic_hits')} AS relevance
    FROM (
      SELECT {keys}, coalesce(n, 0) AS n_tokens, coalesce(u, 0) AS unique_terms,
             coalesce(h, 0) AS topic_hits, coalesce(kw, CAST([] AS VARCHAR[])) AS top_keywords
      FROM (SELECT DISTINCT {keys} FROM {source}) LEFT JOIN (
        SELECT {keys}, CAST(sum(tf) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS u,
               CAST(sum(tf * {prefix_hits('term', prefixes)}) AS BIGINT) AS h,
               list(term ORDER BY tf DESC, term)[1:12] AS kw
        FROM ({term_freq(source, keys, text)}) GROUP BY {', '.join(key_list)}
      ) {using}
    )"""


# --- pages ------------------------------------------------------------------


def decode(text: str) -> str:
    """Character references that occur in the page table."""
    once = f"replace(replace(replace({text}, '&quot;', '\"'), '&copy;', '\u00a9'), '&middot;', '\u00b7')"
    return f"regexp_replace({once}, '&amp;?', '&', 'g')"


BREAK = "'<[^>]*>'"
ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
NAV = "regexp_extract(html, '<nav>(.*)</nav>', 1, 's')"
SPACE = "e' \\t\\n\\r'"


def text_nodes(markup: str) -> str:
    return (
        f"list_transform(list_filter(regexp_split_to_array({markup}, {BREAK}), lambda x: x <> ''), "
        f"lambda x: {decode('x')})"
    )


def visible_text(nav: str = NAV, article: str = ARTICLE) -> str:
    pieces = f"list_transform(list_concat({text_nodes(nav)}, {text_nodes(article)}), lambda x: trim(x, {SPACE}))"
    return f"array_to_string(list_filter({pieces}, lambda x: strlen(x) > 3), ' ')"


def joined_text(markup: str) -> str:
    return f"trim(array_to_string({text_nodes(markup)}, ' '), {SPACE})"


H1 = f"trim({decode('regexp_extract(html, $$<h1>(.*?)</h1>$$, 1, $$s$$)')}, {SPACE})"
TITLE = f"trim({decode('regexp_extract(html, $$<title>(.*?)</title>$$, 1, $$s$$)')}, {SPACE})"


def paragraph_lines(article: str = ARTICLE) -> str:
    """All <p> texts of more than 20 bytes, one per line."""
    each = (
        f"list_transform(string_split({article}, '<p>')[2:], "
        f"lambda x: array_to_string({text_nodes('x').replace('lambda x:', 'lambda y:').replace('x <>', 'y <>').replace('replace(x,', 'replace(y,')}, ' '))"
    )
    longer = f"list_filter({each}, lambda x: strlen(trim(x, {SPACE})) > 20)"
    return f"trim(array_to_string({longer}, e'\\n'), {SPACE})"


def paragraphs(article: str = ARTICLE) -> str:
    """The paragraph fallback of the body."""
    text = paragraph_lines(article)
    return f"CASE WHEN strlen({text}) > 50 THEN {text} ELSE '{vocab.NO_BODY}' END"


def body(article: str = ARTICLE) -> str:
    return (
        f"CASE WHEN strlen({joined_text(article)}) >= {dom.MIN_BODY_BYTES} "
        f"THEN {joined_text(article)} ELSE {paragraphs(article)} END"
    )


def title() -> str:
    return (
        f"CASE WHEN strlen({H1}) >= 5 THEN {H1} WHEN {TITLE} <> '' THEN {TITLE} "
        f"ELSE '{vocab.NO_TITLE}' END"
    )


def articles(source: str, prefixes=vocab.TOPIC_TERMS) -> str:
    """url, title, body, n_tokens, relevance, top_keywords, category of plain pages."""
    return f"""
    SELECT f.url, title, body, n_tokens, unique_terms, relevance, top_keywords, category
    FROM (SELECT url, {title()} AS title, {body()} AS body FROM {source}) f
    JOIN ({scores(f"(SELECT url, {visible_text()} AS vt FROM {source})", "url", "vt", prefixes)}) s
      ON f.url = s.url"""


# --- links ------------------------------------------------------------------

SAFE = "[!#-;=?-_a-z|~]"


def encode_path(path: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({path}, ''), lambda c: CASE WHEN "
        f"regexp_full_match(c, '{SAFE}') THEN c ELSE url_encode(c) END), '')"
    )


ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def canonical() -> str:
    return f"{ORIGIN} || CASE WHEN {PATH} = '' THEN '/' ELSE {encode_path(PATH)} END"


def score(url: str, anchor: str) -> str:
    """Priority in hundredths of a canonical url."""
    articles_, noise = quoted(vocab.ARTICLE_SIGNALS), quoted(vocab.NOISE_SIGNALS)
    path = f"regexp_replace({url}, '^[a-z]+://[^/]*', '')"
    depth = f"len(list_filter(string_split({path}, '/'), lambda s: s <> ''))"

    def hits(words: str, text: str) -> str:
        return f"len(list_filter([{words}], lambda s: contains(lower({text}), s)))"

    return (
        f"greatest(0, least(100, 40 + 8 * {hits(articles_, url)} + 4 * {hits(articles_, anchor)} "
        f"+ CASE WHEN contains({url}, '/202') OR contains({url}, '/201') THEN 15 ELSE 0 END "
        f"+ CASE WHEN {depth} BETWEEN 3 AND 6 THEN 10 ELSE 0 END - 20 * {hits(noise, url)}))"
    )


def raw_links(source: str, columns: str = "url") -> str:
    """One row per link of the page table: columns, pos, href, anchor."""
    return f"""
    SELECT {columns}, pos - 1 AS pos,
           {decode('hrefs[pos]')} AS href, trim({decode('anchors[pos]')}, {SPACE}) AS anchor
    FROM (
      SELECT *, unnest(range(1, len(hrefs) + 1)) AS pos FROM (
        SELECT *, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
               regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS anchors
        FROM {source}
      )
    )"""


def ranked(resolved: str, limit: int = vocab.LINKS_PER_PAGE) -> str:
    """Rank (page_url, pos, target, anchor) rows; first occurrence per target."""
    return f"""
    SELECT page_url, pos, target AS url, anchor, hundredths / 100.0::DOUBLE AS priority, rank
    FROM (
      SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY hundredths DESC, pos) AS rank
      FROM (
        SELECT *, {score('target', 'anchor')} AS hundredths FROM (
          SELECT page_url, target, min(pos) AS pos, arg_min(anchor, pos) AS anchor
          FROM ({resolved}) GROUP BY page_url, target
        )
      )
    ) WHERE rank <= {limit}"""
