"""Pages -> articles, and the text forms of articles."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.functions import dom
from pageloom.functions.expr import add_struct
from pageloom.operators.dom import parse_pages
from pageloom.functions.entities import merge_entities
from pageloom.operators.entities import (
    Recogniser, collect_entities, detect_entities, dictionary_detector, dictionary_entries, dictionary_spans, fits_broadcast,
)
from pageloom.operators.scoring import keep_relevant, run_figures, with_scores
from pageloom.plans.staging import stage

# Output fields in order, and the layout of the summary card.
ARTICLE_FIELDS = [
    "url", "title", "author", "published_date", "body_preview", "word_count",
    "relevance_score", "top_keywords", "named_entities", "inferred_category",
]
BAR = "--" * 60
CARD_ENTITIES = 5
CARD_PREVIEW_CHARS = 200


def extract_articles(
    pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] = (),
    threshold: float | None = None, load_recogniser: Callable[[], Recogniser] | None = None,
    topic_terms: list[str] = vocab.TOPIC_TERMS, documented: bool = True,
    dictionary: DataFrame | None = None, dictionary_words: int = 3, status: str | None = None,
    observation: Observation | None = None,
) -> DataFrame:
    """One article per page, plus the ``keep`` columns in front.

    Works on batch and streaming tables alike: nothing here needs another row, so
    the whole plan is one stage without a shuffle.  Pages are parsed once, scored,
    cut by ``threshold`` and only then searched for fields and entities.

    Entities come from the recogniser, then from the ``dictionary`` (``text, label``; runs
    of up to ``dictionary_words`` words).  A dictionary too large to copy to the workers is
    joined instead, on rows that are written down first (batch tables only).  ``status``
    names a column, last in the table, for what became of a page in the recogniser.
    ``observation`` gets ``pages_in``, ``kept`` and ``discarded`` from the run itself.
    """
    keys = [*keep, F.col(url).alias("url")]
    parsed = parse_pages(pages, keys, html)
    stats = dom.page_stats("nodes", tuple(topic_terms))
    scored = with_scores(add_struct(parsed, [*keep, "url", "nodes"], stats))
    if observation is not None:
        scored = scored.observe(observation, *run_figures(threshold))
    if threshold is not None:
        scored = keep_relevant(scored, threshold)
    found = {
        name: dom.page_field(name, "nodes", documented)
        for name in ("title", "author", "published_date", "body")
    }
    fields = scored.withColumns({**found, "word_count": F.col("n_tokens")})
    columns = [*keep, *ARTICLE_FIELDS, *([] if status is None else [status])]
    preview = dom.body_preview(F.col("body")).alias("body_preview")
    entries = None if dictionary is None else dictionary_entries(dictionary)
    if entries is None or fits_broadcast(entries):
        lookup = None if entries is None else dictionary_detector(entries, dictionary_words)
        found = detect_entities(fields, "body", load_recogniser, status=status, lookup=lookup)
        return found.withColumn("body_preview", preview).select(columns)
    found = detect_entities(fields, "body", load_recogniser, status=status)
    written = stage(found.select(
        *[c for c in columns if c != "body_preview"], preview, F.nullif("body", F.lit(vocab.NO_BODY)).alias("_body"),
        F.monotonically_increasing_id().alias("_row")), "found-articles")
    spans = dictionary_spans(written, ["_row"], "_body", entries, dictionary_words)
    named = collect_entities(spans, ["_row"]).withColumnRenamed("named_entities", "_entries")
    merged = merge_entities(F.col("named_entities"), F.col("_entries"))
    return written.drop("_body").join(named, "_row", "left").withColumn("named_entities", merged).select(columns)


def articles_as_json(articles: DataFrame) -> DataFrame:
    """``url, json``: pretty text with null author and date written as null."""
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return articles.select("url", F.to_json(F.struct(*ARTICLE_FIELDS), options).alias("json"))


def summary_card(articles: DataFrame) -> DataFrame:
    """``url, card``: the human-readable block of one article."""
    return articles.select("url", card_text().alias("card"))


def card_text() -> Column:
    def line(label: str, value: Column) -> Column:
        return F.concat(F.lit(label), value)

    entities = F.transform(
        F.slice("named_entities", 1, CARD_ENTITIES),
        lambda e: F.concat(e["text"], F.lit(" ["), e["kind"], F.lit("]")),
    )
    preview = F.translate(F.left("body_preview", F.lit(CARD_PREVIEW_CHARS)), "\n", " ")
    return F.concat_ws(
        "\n",
        F.lit(""),
        F.lit(BAR),
        line(" \u25a0  ", F.col("url")),
        F.lit(BAR),
        line(" Title  : ", F.col("title")),
        line(" Author : ", F.coalesce("author", F.lit("--"))),
        line(" Date   : ", F.coalesce("published_date", F.lit("--"))),
        line(" Category : ", F.col("inferred_category")),
        # format_number rounds the exact binary value, format_string its decimal text
        F.format_string(
            " Relevance : %s | Words: %d", F.format_number("relevance_score", 3), "word_count"
        ),
        F.when(F.size("top_keywords") > 0, line(" Keywords : ", F.array_join("top_keywords", ", "))),
        F.when(F.size("named_entities") > 0, line(" Entities : ", F.array_join(entities, "  •  "))),
        line(" Preview : ", preview),
        F.lit(BAR),
    )


def latest_per_url(log: DataFrame, order: str, url: str = "url") -> DataFrame:
    """Newest row of each url in an append log.

    The rank becomes a group limit before the shuffle, so a url sends one row per task,
    however many versions it has.  Rows without an order are the oldest; equal orders go by
    the row's hash, so the choice is the same in every run.
    """
    newest = Window.partitionBy(url).orderBy(F.col(order).desc_nulls_last(), F.xxhash64(*log.columns).desc())
    return log.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank")
