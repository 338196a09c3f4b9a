"""A streaming source over folders that sees every HTML file, new or modified.

Spark's file stream reports a path once and leaves out files of length 0 and hidden names.
This source asks by time instead: a batch holds the files whose modification time lies
after the last batch's offset and up to its own, so a file that changes comes again.  The
offset is that time alone; nothing else is remembered, and a batch that is repeated after a
failure lists the same span of time.  Folders are listed and files are opened by the tasks;
the folders below a watched one are dealt to at most ``tasks`` of them.

``settle`` seconds must have passed since a file was modified, so files that are still being
written wait for the next batch.  A file moved in with an old modification time is not
seen; ``streaming.watch.run_rescan`` finds those by its ledger.
"""

import re
import sys
import time
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pageloom.sources import html_files

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary, message string"
_ARROW = pa.schema([
    ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()),
    ("content", pa.binary()), ("message", pa.string())])
_HTML = re.compile(r"\.html$", re.I)
_BATCH_BYTES = 32 * 1024 * 1024


class Folders(InputPartition):
    """Folders to list, each with or without the folders below it, and a span of time."""

    def __init__(self, folders: list[tuple[str, bool]], after: int, until: int):
        self.folders, self.after, self.until = folders, after, until


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.dirs = options["dirs"].split("\n")
        self.settle = int(float(options.get("settle", "2")) * 1e9)
        self.tasks = int(options.get("tasks", "200"))

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[Folders]:
        found = []
        for path in self.dirs:
            found.append((path, False))
            system, inside = html_files.opened(path)
            below = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
            found += [(f"{path.rstrip('/')}/{info.base_name}", True) for info in below if info.type == fs.FileType.Directory]
        dealt = [found[i::self.tasks] for i in range(min(self.tasks, len(found)))]
        return [Folders(part, start["until"], end["until"]) for part in dealt]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path, below in partition.folders:
            system, inside = html_files.opened(path)
            root = len(inside.rstrip("/"))
            for info in system.get_file_info(fs.FileSelector(inside, allow_not_found=True, recursive=below)):
                if not (info.is_file and _HTML.search(info.base_name) and partition.after < info.mtime_ns <= partition.until):
                    continue
                content, message = html_files.read_file(system, info.path)
                changed = datetime.fromtimestamp(info.mtime_ns // 1000 / 1e6, timezone.utc)
                rows.append((path.rstrip("/") + info.path[root:], changed, info.size, content, message))
                size += len(content or b"")
                if size >= _BATCH_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)

    def commit(self, end: dict) -> None:
        pass


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(zip(*rows), _ARROW)], schema=_ARROW)


class HtmlFolders(DataSource):
    """``spark.readStream.format("html_folders")``: options ``dirs`` (one a line), ``settle``, ``tasks``."""

    @classmethod
    def name(cls) -> str:
        return "html_folders"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def stream_folders(spark: SparkSession, dirs: list[str], settle: float = 2.0) -> DataFrame:
    """Stream ``path, modificationTime, length, content, message`` of the HTML files below ``dirs``."""
    spark.dataSource.register(HtmlFolders)
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    return spark.readStream.format("html_folders").options(dirs="\n".join(dirs), settle=str(settle), tasks=tasks).load()


# Task code travels with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
