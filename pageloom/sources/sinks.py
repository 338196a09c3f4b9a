"""Article outputs, and pages as files."""

import posixpath
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.plans.staging import stage
from pageloom.sources.html_files import opened


def write_articles_json(articles: DataFrame, path: str) -> None:
    """Overwrite ``path`` with one JSON object per line, nulls written out."""
    articles.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_articles(articles: DataFrame, path: str, checkpoint: str, **trigger):
    """Append a stream of articles; the checkpoint lets a restart go on."""
    return (
        articles.writeStream.format("json")
        .outputMode("append")
        .option("ignoreNullFields", "false")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = set()
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            system, inside = opened(path)
            folder = posixpath.dirname(inside)
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(inside) as file:
                file.write(content.as_py() or b"")
        yield batch.select(["path"])


def write_html_files(files: DataFrame) -> DataFrame:
    """Write a file per row of ``path, content`` (binary); returns the table of their paths.

    Each task writes its rows; a repeated task writes the same files again.
    """
    rows = files.select("path", F.col("content").cast("binary").alias("content"))
    return stage(rows.mapInArrow(_write_batches, "path string"), "written-files")


# Task code travels with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
