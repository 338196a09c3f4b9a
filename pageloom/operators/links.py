"""Link tables of pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import links
from pageloom.functions.expr import explode_structs
from pageloom.functions.hosts import host_forms
from pageloom.operators.dom import parse_pages


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Raw links ``page_url, pos, href, anchor`` in document order."""
    parsed = parse_pages(pages, [url], html)
    return explode_structs(
        parsed, [F.col(url).alias("page_url")], links.anchors(F.col("nodes")), "pos"
    )


def with_hosts(parsed: DataFrame, page_url: str) -> DataFrame:
    """Parsed pages plus the map ``hosts``: normal forms of the odd hosts of each page."""
    return parsed.withColumn("hosts", host_forms(links.odd_hosts(F.col(page_url), F.col("nodes"))))


def ranked_links(
    pages: DataFrame, url: str = "url", html: str = "html",
    limit: int | None = vocab.LINKS_PER_PAGE, **signals,
) -> DataFrame:
    """``page_url, pos, url, anchor, priority, depth, rank``; best links first.

    Resolving, the same-host filter, de-duplication, scoring and the cut all
    happen in the page's row, so only the kept links leave it.
    """
    parsed = with_hosts(parse_pages(pages, [url], html).withColumnRenamed(url, "page_url"), "page_url")
    ranked = links.page_ranking(
        "page_url", "nodes", "hosts", limit, **{name: tuple(words) for name, words in signals.items()}
    )
    return explode_structs(parsed, ["page_url"], ranked, "pos")


def frontier_summary(seeds: DataFrame, ranked: DataFrame) -> DataFrame:
    """``seed_url, n_links, best_priority`` (0.0 when a seed has no links)."""
    per_page = ranked.groupBy(F.col("page_url").alias("seed_url")).agg(
        F.count("*").alias("n"), F.max("priority").alias("best")
    )
    return (
        seeds.select(F.col("url").alias("seed_url")).distinct()
        .join(per_page, "seed_url", "left")
        .select(
            "seed_url",
            F.coalesce("n", F.lit(0)).alias("n_links"),
            F.coalesce("best", F.lit(0.0)).alias("best_priority"),
        )
    )
