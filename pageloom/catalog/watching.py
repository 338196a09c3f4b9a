"""Catalog: dictionaries and recognisers in articles, run figures, complete watching, restarts."""

from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.catalog import pages as page_queries
from pageloom.catalog import sql, texts
from pageloom.catalog.pages import page_files, pages
from pageloom.operators import articles
from pageloom.plans.files import FIGURES, write_run
from pageloom.plans.staging import staging_path
from pageloom.streaming.watch import read_figures, read_log, run_stream, stop_after_batch

THRESHOLD = 0.4


def articles_with_dictionary(spark, sf_dir):
    """Articles whose entities come from a dictionary table."""
    found = articles.extract_articles(
        pages(spark, sf_dir), dictionary=texts.benchmark_dictionary(spark, sf_dir), dictionary_words=2)
    return found.select("url", F.array_join(
        F.transform("named_entities", lambda e: F.concat(e["text"], F.lit("/"), e["kind"])), ",").alias("entities"))


def failing_recogniser():
    """A stand-in that takes lists of texts and fails on texts of certain lengths."""

    class Recogniser:
        def batch(self, given, labels):
            if any(len(text) % 7 == 0 for text in given):
                raise ValueError("a text it cannot take")
            return [[(text[:3], labels[0])] for text in given]

    return Recogniser()


def missing_recogniser():
    raise FileNotFoundError("no model here")


def recogniser_status(spark, sf_dir):
    """What became of the pages in a recogniser that fails on some, and in one that is not there."""
    counts = None
    for name, load in (("failing", failing_recogniser), ("missing", missing_recogniser)):
        found = articles.extract_articles(pages(spark, sf_dir), load_recogniser=load, status="status")
        rows = found.groupBy(F.lit(name).alias("recogniser"), "status").agg(
            F.count("*").alias("n"), F.sum(F.size("named_entities")).cast("bigint").alias("entities"))
        counts = rows if counts is None else counts.unionByName(rows)
    return counts


def _broken():
    """Every third page gets a byte that is not UTF-8."""
    html = F.col("html").cast("binary")
    return F.when(F.col("page_id") % 3 == 0, F.concat(html, F.lit(b"\xff"))).otherwise(html)


def run_figures(spark, sf_dir):
    """Figures of a file run over broken and missing files, counted while it writes."""
    written = page_files(spark, sf_dir, staging_path(spark, "files"), _broken())
    gone = written.filter(F.regexp_extract("path", "([0-9]+)[.]html$", 1).cast("bigint") % 5 == 0)
    missing = gone.select(F.regexp_replace("path", "/([0-9]+[.]html)$", "/gone/$1").alias("path"))
    counted = write_run(
        spark, written.select("path").union(missing), staging_path(spark, "articles"), THRESHOLD, topic_terms=texts.PREFIXES)
    return spark.createDataFrame([tuple(counted[name] for name in FIGURES)], ", ".join(f"{name} bigint" for name in FIGURES))


def watched_figures(spark, sf_dir):
    """The same figures of a watched folder, added up over its batches."""
    out = staging_path(spark, "watch")
    page_files(spark, sf_dir, f"{out}/in", _broken())
    query, _ = run_stream(
        spark, [f"{out}/in"], f"{out}/log", f"{out}/checkpoint", THRESHOLD, topic_terms=texts.PREFIXES,
        source="folders", settle=0, figures=f"{out}/figures")
    query.awaitTermination()
    return read_figures(spark, f"{out}/figures").agg(*[F.sum(name).alias(name) for name in FIGURES])


def watched_folders(spark, sf_dir):
    """Newest articles of a watched folder with empty and hidden files, a third of them modified later."""
    out = staging_path(spark, "watch")
    hidden = F.when(F.col("page_id") % 5 == 0, "_").otherwise("")
    content = F.when(F.col("page_id") % 7 == 0, F.lit("")).otherwise(F.col("html"))
    page_files(spark, sf_dir, f"{out}/in", content, hidden)

    def watch():
        query, _ = run_stream(
            spark, [f"{out}/in"], f"{out}/log", f"{out}/checkpoint", 0.0, topic_terms=texts.PREFIXES, source="folders", settle=0)
        query.awaitTermination()

    watch()
    changed = F.replace(content, F.lit("<h1>"), F.lit(f"<h1>{page_queries.SECOND} "))
    page_files(spark, sf_dir, f"{out}/in", changed, hidden, where="page_id % 3 = 0")
    watch()
    return page_queries.by_page(articles.latest_per_url(read_log(spark, f"{out}/log"), order="batch"))


def restarted_watch(spark, sf_dir):
    """A watch that is stopped after a batch and started again on its checkpoint, with new files in between."""
    out = staging_path(spark, "watch")
    jobs = {"threshold": THRESHOLD, "topic_terms": texts.PREFIXES, "source": "folders", "settle": 0}
    page_files(spark, sf_dir, f"{out}/in", where="page_id % 2 = 0")
    jobs["trigger"] = {"processingTime": "1 second"}

    def watch(batches: int):
        query, _ = run_stream(spark, [f"{out}/in"], f"{out}/log", f"{out}/checkpoint", **jobs)
        stop_after_batch(query, batches)

    watch(1)
    page_files(spark, sf_dir, f"{out}/in", where="page_id % 2 = 1")
    watch(2)  # the first of them may be one that the stop cut short
    return page_queries.by_page(read_log(spark, f"{out}/log"))


QUERIES = {
    f.__name__: f
    for f in (articles_with_dictionary, recogniser_status, run_figures, watched_figures, watched_folders, restarted_watch)
}

_ARTICLES = sql.articles("pages", texts.PREFIXES)
_BODY = f"SELECT url, CASE WHEN body <> '{vocab.NO_BODY}' THEN body END AS body FROM ({_ARTICLES})"
_FIRST = f"SELECT * FROM (SELECT page_id, n_tokens, relevance FROM ({_ARTICLES}) JOIN pages USING (url))"


def _figures_sql(missing: str) -> str:
    return f"""SELECT n + gone AS files, n - broken AS pages_in, broken + gone AS read_errors, n - broken - kept AS discarded, kept
        FROM (SELECT count(*) AS n, {missing} AS gone, count_if(page_id % 3 = 0) AS broken,
          count_if(page_id % 3 <> 0 AND relevance >= {THRESHOLD}::DOUBLE) AS kept FROM ({_FIRST}))"""


_CHANGED = f"CASE WHEN page_id % 3 = 0 THEN replace(html, '<h1>', '<h1>{page_queries.SECOND} ') ELSE html END"

ORACLES = {
    "articles_with_dictionary": texts.spans_sql(f"({_BODY})", "url", "body") + f"""
        SELECT url, coalesce(string_agg(text || '/' || kind, ',' ORDER BY rank), '') AS entities
        FROM pages LEFT JOIN firsts USING (url) GROUP BY url""",
    "recogniser_status": f"""
        WITH b AS (SELECT body, CASE WHEN body IS NULL THEN 'no text' WHEN length(body) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM ({_BODY}))
        SELECT 'failing' AS recogniser, status, count(*) AS n, count_if(status = 'ok') AS entities FROM b GROUP BY status
        UNION ALL SELECT 'missing', CASE WHEN body IS NULL THEN 'no text' ELSE 'not loaded' END, count(*), 0 FROM b GROUP BY 2""",
    "run_figures": _figures_sql("count_if(page_id % 5 = 0)"),
    "watched_figures": _figures_sql("0"),
    "watched_folders": page_queries.by_page_sql(sql.articles(
        f"(SELECT url, {_CHANGED} AS html FROM pages WHERE page_id % 7 <> 0)", texts.PREFIXES)) + f"""
        UNION ALL SELECT page_id, '{vocab.NO_TITLE}', 0, 0, '' FROM pages WHERE page_id % 7 = 0""",
    "restarted_watch": page_queries.by_page_sql(_ARTICLES, f"relevance >= {THRESHOLD}::DOUBLE"),
}
