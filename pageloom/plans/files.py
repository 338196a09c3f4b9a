"""File mode: HTML files -> articles."""

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.operators.articles import extract_articles
from pageloom.sources.html_files import listed_files, read_html_files, read_paths, split_readable
from pageloom.sources.sinks import write_articles_json


def run_files(
    spark: SparkSession, paths: list[str] | DataFrame, threshold: float = vocab.DEFAULT_THRESHOLD, **options
) -> tuple[DataFrame, DataFrame]:
    """(articles that reach the threshold, quarantined files)."""
    pages, quarantine = read_html_files(spark, paths)
    return extract_articles(pages, threshold=threshold, **options), quarantine


FIGURES = ["files", "pages_in", "read_errors", "discarded", "kept"]


def write_pages(files: DataFrame, write, threshold: float, **options) -> dict[str, int]:
    """Extract a table of opened files, hand the articles to ``write`` and return the run's figures.

    Files are read once: Spark counts what passes by while the articles are written.
    """
    read, scored = Observation(), Observation()
    readable = F.coalesce(F.is_valid_utf8("content"), F.lit(False))
    counted = files.observe(
        read, F.count(F.lit(1)).alias("files"), F.count_if(~readable).alias("read_errors"))
    pages, _ = split_readable(counted)
    write(extract_articles(pages, threshold=threshold, observation=scored, **options))
    return {name: (read.get | scored.get).get(name) or 0 for name in FIGURES}


def write_run(
    spark: SparkSession, paths: list[str] | DataFrame, out: str,
    threshold: float = vocab.DEFAULT_THRESHOLD, **options,
) -> dict[str, int]:
    """A whole run: files -> articles as JSON lines in ``out``.

    Returns ``files, pages_in, read_errors, discarded, kept``, counted during the run.
    """
    files = read_paths(listed_files(spark, paths))
    return write_pages(files, lambda articles: write_articles_json(articles, out), threshold, **options)
