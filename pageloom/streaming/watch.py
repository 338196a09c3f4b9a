"""Watch mode: a stream of HTML files -> appended articles.

Extraction needs no state, so the batch operator runs unchanged on the stream and
there is no watermark to keep.  Progress lives in the checkpoint: a restart goes
on where the last run stopped and earlier results stay.  Spark's file stream reports a path
once and no empty or hidden files; ``source="folders"`` reports all, and modified files
again; ``run_rescan`` finds what was modified since by a ledger.
"""

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom import vocab
from pageloom.operators.articles import extract_articles
from pageloom.plans.files import FIGURES, write_pages
from pageloom.sources.folder_stream import stream_folders
from pageloom.sources.html_files import (
    changed_files, existing_dirs, exists, read_paths, split_readable, stream_html_files,
)
from pageloom.sources.sinks import write_articles_json

_FIGURES = ", ".join(f"{name} bigint" for name in FIGURES)


def stream_articles(
    pages: DataFrame, threshold: float = vocab.DEFAULT_THRESHOLD, **options
) -> DataFrame:
    """Stream of ``url, html`` -> stream of articles above the threshold."""
    return extract_articles(pages, threshold=threshold, **options)


def write_articles(
    files: DataFrame, batch: int, out: str, threshold: float, quarantine: str | None,
    figures: str | None = None, **options
) -> None:
    """Extract a table of files into one partition of the article log.

    A batch that is retried after a failure overwrites its own folder, so files are
    never appended twice.  The run's figures are counted while it writes.
    """
    counted = write_pages(
        files, lambda articles: write_articles_json(articles, f"{out}/batch={batch}"), threshold, **options)
    if quarantine is not None:
        _, unreadable = split_readable(files)
        unreadable.write.mode("overwrite").json(f"{quarantine}/batch={batch}")
    if figures is not None:
        row = files.sparkSession.createDataFrame([tuple(counted[name] for name in FIGURES)], _FIGURES)
        row.write.mode("overwrite").json(f"{figures}/batch={batch}")


def _remember(files: DataFrame, ledger: str, batch: int) -> None:
    with_ledger_columns(files).write.mode("overwrite").parquet(f"{ledger}/batch={batch}")


def handle_batch(
    out: str, threshold: float, options: dict, quarantine: str | None, ledger: str | None = None,
    figures: str | None = None,
) -> Callable[[DataFrame, int], None]:
    """Batch function of ``run_stream``: articles first, then the ledger."""

    def handle(files: DataFrame, batch_id: int) -> None:
        write_articles(files, batch_id, out, threshold, quarantine, figures, **options)
        if ledger is not None:
            _remember(files, ledger, batch_id)

    return handle


def run_stream(
    spark: SparkSession, dirs: list[str], out: str, checkpoint: str,
    threshold: float = vocab.DEFAULT_THRESHOLD, quarantine: str | None = None,
    trigger: dict | None = None, ledger: str | None = None, source: str = "files",
    settle: float = 2.0, figures: str | None = None, **options,
):
    """Watch the valid directories among ``dirs`` for new files.

    Returns (query or None when no directory is valid, invalid (item, message)).
    Stop it with ``query.stop()``.  ``trigger`` defaults to ``availableNow``; pass
    ``{"processingTime": "10 seconds"}`` to keep watching.  A restart may name other
    directories.  ``ledger`` is a folder that remembers what was processed, for
    ``run_rescan``.  ``source="folders"`` sees every file, see ``sources.folder_stream``;
    ``availableNow`` is one batch there, after a stop in the middle of one just that batch.
    ``figures`` is a folder for the figures of each batch (``read_figures``).
    """
    valid, invalid = existing_dirs(spark, dirs)
    if not valid:
        return None, invalid
    files = stream_folders(spark, valid, settle) if source == "folders" else stream_html_files(spark, valid)
    query = (
        files.writeStream.foreachBatch(handle_batch(out, threshold, options, quarantine, ledger, figures))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    return query, invalid


def run_rescan(
    spark: SparkSession, dirs: list[str], out: str, ledger: str,
    threshold: float = vocab.DEFAULT_THRESHOLD, quarantine: str | None = None, since: str | None = None, **options,
) -> DataFrame | None:
    """Append the articles of new and modified files to the log of ``run_stream``.

    Reads the ledger, opens only files whose path and time it does not hold, and adds
    them to it once their articles are written; after a failure in between they are
    processed again, as a later batch.  Batches are numbered by the clock, so they come
    after all batches of a stream: ``latest_per_url(read_log(...), "batch")`` is the
    newest state.  Returns ``path, modificationTime`` of the files, None without a directory.
    """
    valid, _ = existing_dirs(spark, dirs)
    if not valid:
        return None
    changed = changed_files(spark, valid, read_ledger(spark, ledger), since)
    if not changed.isEmpty():
        batch = time.time_ns() // 1_000_000
        write_articles(read_paths(changed), batch, out, threshold, quarantine, **options)
        _remember(changed, ledger, batch)
    return changed


def stop_after_batch(query, batches: int = 1, seconds: float = 600.0) -> None:
    """Stop a running query once ``batches`` more batches are through.

    A batch that has begun by then is cut short; a restart on the same checkpoint does it
    again, into the same folders, before it goes on.  Raises the query's error if it fails, TimeoutError after ``seconds``.
    """
    def done() -> int:
        return len({progress["batchId"] for progress in query.recentProgress})

    first, end = done(), time.monotonic() + seconds
    while done() < first + batches and query.isActive:
        if time.monotonic() > end:
            raise TimeoutError(f"no batch within {seconds} seconds")
        time.sleep(0.1)
    query.stop()
    if query.exception() is not None:
        raise query.exception()


def read_figures(spark: SparkSession, figures: str) -> DataFrame:
    """``files, pages_in, read_errors, discarded, kept, batch`` of the batches of ``run_stream``."""
    return spark.read.schema(f"{_FIGURES}, batch bigint").option("basePath", figures).json(f"{figures}/batch=*")


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """``path, modificationTime, seen_at`` of all files processed; empty without a ledger."""
    schema = "path string, modificationTime timestamp, seen_at timestamp"
    if not exists(spark, ledger):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{ledger}/batch=*")


def read_log(spark: SparkSession, out: str) -> DataFrame:
    """Article log of ``run_stream`` with the ``batch`` it was written in."""
    schema = (
        "url string, title string, author string, published_date string, body_preview string, "
        "word_count bigint, relevance_score double, top_keywords array<string>, "
        "named_entities array<struct<text:string,kind:string>>, inferred_category string, batch bigint"
    )
    return spark.read.schema(schema).option("basePath", out).json(f"{out}/batch=*")


def with_ledger_columns(files: DataFrame) -> DataFrame:
    """What ``rescan_modified`` needs to remember about processed files."""
    return files.select("path", "modificationTime", F.current_timestamp().alias("seen_at"))
