"""All links of a page, resolved, filtered, de-duplicated and ranked in its row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import dom, urls
from pageloom.functions.expr import built_once, let, trim_space


def anchors(nodes: Column) -> Column:
    """``array<struct<pos, href, anchor>>`` of every a[href] in document order."""
    return F.transform(
        F.filter(nodes, dom.has_attr("href", tag="a")),
        lambda a, i: F.struct(
            i.alias("pos"),
            F.element_at(a["attrs"], "href").alias("href"),
            trim_space(dom.raw_text(nodes, a, "")).alias("anchor"),
        ),
    )


def odd_hosts(page_url: Column, nodes: Column) -> Column:
    """Hosts of a page and its links that need ``hosts.host_forms``; mostly none."""
    links = F.transform(
        F.filter(nodes, dom.has_attr("href", tag="a")), lambda a: urls.odd_host(F.element_at(a["attrs"], "href"))
    )
    written = F.concat(F.array(urls.odd_host(page_url)), F.coalesce(links, F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(written))


def same_host_links(page_url: Column, anchor_array: Column, hosts: Column) -> Column:
    """Canonical same-host links, first occurrence of each, by url.

    Sorting by (url, pos) puts repeats next to each other, so the first one is
    found by looking at the left neighbour: O(n log n) for any number of links.
    """

    def resolve(base: Column) -> Column:
        def one(link: Column) -> Column:
            return let(
                urls.join_parts(base, link["href"], hosts),
                lambda parts: F.when(
                    urls.host_of(parts) == urls.host_of(base),
                    F.struct(
                        urls.format_parts(parts, canonical=True).alias("url"),
                        link["pos"].alias("pos"),
                        link["anchor"].alias("anchor"),
                    ),
                ),
            )

        found = F.filter(F.transform(anchor_array, one), lambda link: link.isNotNull())
        return let(
            F.sort_array(found),
            lambda s: F.filter(
                s, lambda link, i: (i == 0) | (link["url"] != F.get(s, i - 1)["url"])
            ),
        )

    return let(urls.url_parts(page_url, hosts), resolve)


def ranked_links(
    page_url: Column, anchor_array: Column, hosts: Column,
    limit: int | None = vocab.LINKS_PER_PAGE, **signals,
) -> Column:
    """``array<struct<pos, url, anchor, priority, depth, rank>>``, best first.

    Priority descending, ties in document order; ``limit=None`` keeps all.
    """
    scored = F.transform(
        same_host_links(page_url, anchor_array, hosts),
        lambda link: F.struct(
            (-urls.link_score(link["url"], link["anchor"], **signals)).alias("order"),
            link["pos"].alias("pos"),
            link["url"].alias("url"),
            link["anchor"].alias("anchor"),
        ),
    )
    ordered = F.sort_array(scored)
    if limit is not None:
        ordered = F.slice(ordered, 1, limit)
    return F.transform(
        ordered,
        lambda link, i: F.struct(
            link["pos"].alias("pos"),
            link["url"].alias("url"),
            link["anchor"].alias("anchor"),
            (-link["order"].cast("double") / 100.0).alias("priority"),
            F.lit(1).alias("depth"),
            (i + 1).alias("rank"),
        ),
    )


@built_once
def page_ranking(
    page_url: str, nodes: str, hosts: str, limit: int | None,
    article_signals: tuple = tuple(vocab.ARTICLE_SIGNALS),
    noise_signals: tuple = tuple(vocab.NOISE_SIGNALS),
) -> Column:
    """``ranked_links`` of a table with these column names."""
    return ranked_links(
        F.col(page_url), anchors(F.col(nodes)), F.col(hosts), limit,
        article_signals=article_signals, noise_signals=noise_signals,
    )


@built_once
def seed_visits(page_url: str, nodes: str, hosts: str, limit: int) -> Column:
    """The page itself as rank 0, then its best links."""
    own = F.struct(
        F.lit(-1).alias("pos"),
        F.col(page_url).alias("url"),
        F.lit("").alias("anchor"),
        F.lit(1.0).alias("priority"),
        F.lit(0).alias("depth"),
        F.lit(0).alias("rank"),
    )
    best = F.coalesce(page_ranking(page_url, nodes, hosts, limit), F.array())
    return F.concat(F.array(own), best)
