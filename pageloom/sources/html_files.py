"""HTML files as pages."""

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pageloom.operators.validation import is_html_path
from pageloom.plans.staging import stage

# Fixed value: files with this extension in any letter case are watched.
HTML_GLOB = "*.[hH][tT][mM][lL]"
# Contents go from a task to Spark in batches of about so many bytes.
_BATCH_BYTES = 32 * 1024 * 1024
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def file_url(path: Column) -> Column:
    """``file://`` + absolute path for local files; another scheme stays as it is."""
    local = F.concat(F.lit("file://"), F.regexp_replace(path, "^file:(//)?", ""))
    return F.when(path.rlike("^(?!file:)[A-Za-z][A-Za-z0-9+.-]*:"), path).otherwise(local)


def split_readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages ``url, html``, quarantine ``item, message``) of a table ``path, content``.

    A column ``message`` says why a file has no content.
    """
    readable = F.is_valid_utf8("content")
    pages = files.filter(readable).select(
        file_url(F.col("path")).alias("url"), F.col("content").cast("string").alias("html")
    )
    message = F.lit("not valid UTF-8")
    if "message" in files.columns:
        message = F.coalesce("message", message)
    unreadable = files.filter(~F.coalesce(readable, F.lit(False))).select(
        F.col("path").alias("item"), message.alias("message"))
    return pages, unreadable


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system of a path and the path inside it; for use on executors."""
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), re.sub("^file:(//)?", "", path)


_LISTED = "path string, refused string, is_folder boolean"


def _listed(rows: list[tuple]) -> pa.RecordBatch:
    paths, refused, folders = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(refused, pa.string()), pa.array(folders, pa.bool_())],
        ["path", "refused", "is_folder"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What was named: files, folders, and a message for what is missing."""
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            try:
                system, inside = opened(path)
                kind = system.get_file_info(inside).type
                message = "file not found" if kind == fs.FileType.NotFound else None
                rows.append((path, message, kind == fs.FileType.Directory))
            except (OSError, ValueError) as error:
                rows.append((path, f"cannot be read: {type(error).__name__}", False))
        yield _listed(rows)


def _children(hidden: bool):
    """Files and folders directly below each folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    system, inside = opened(path)
                    found = system.get_file_info(fs.FileSelector(inside))
                    prefix = path.rstrip("/")
                    yield _listed([
                        (f"{prefix}/{info.base_name}", None, info.type == fs.FileType.Directory)
                        for info in found if hidden or info.base_name[0] not in "._"])
                except (OSError, ValueError) as error:
                    yield _listed([(path, f"cannot be read: {type(error).__name__}", False)])

    return run


def listed_files(spark: SparkSession, paths: list[str] | DataFrame, hidden: bool = False) -> DataFrame:
    """``path, refused`` of the files named by ``paths`` or below the folders named there.

    Folders are listed level by level: each level's folders are rows, dealt anew to all
    tasks, so a tree of folders is listed by many tasks and no list passes the driver.
    Inside folders, names that begin with ``_`` or ``.`` count with ``hidden`` only.
    """
    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(path,) for path in paths], "path string")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = stage(paths.select("path").mapInArrow(_named, _LISTED), "listed")
    files = level.filter("NOT is_folder")
    while not (folders := level.filter("is_folder")).isEmpty():
        level = stage(
            folders.select("path").repartition(tasks, "path").mapInArrow(_children(hidden), _LISTED), "listed")
        files = files.unionByName(level.filter("NOT is_folder"))
    return files.select("path", "refused")


def read_file(system: fs.FileSystem, inside: str) -> tuple[bytes | None, str | None]:
    """(content, None) of a file, or (None, why it cannot be read)."""
    try:
        with system.open_input_stream(inside) as stream:
            return stream.read(), None
    except OSError as error:
        return None, f"cannot be read: {type(error).__name__}"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``content`` and, where that is null, ``message``."""
    for batch in batches:
        refused = batch.column("refused").to_pylist() if "refused" in batch.schema.names else None
        start, size, contents, messages = 0, 0, [], []

        def rows(stop):
            columns = batch.slice(start, stop - start).columns
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(contents, pa.binary()), pa.array(messages, pa.string())],
                [*batch.schema.names, "content", "message"])

        for i, path in enumerate(batch.column("path").to_pylist()):
            content, message = None, refused[i] if refused else None
            if message is None:
                try:
                    content, message = read_file(*opened(path))
                except (OSError, ValueError) as error:
                    message = f"cannot be read: {type(error).__name__}"
            contents.append(content)
            messages.append(message)
            size += len(content or b"")
            if size >= _BATCH_BYTES:
                yield rows(i + 1)
                start, size, contents, messages = i + 1, 0, [], []
        if contents:
            yield rows(batch.num_rows)


def read_paths(paths: DataFrame) -> DataFrame:
    """``paths`` plus ``content`` and ``message`` of the file named in column ``path``.

    Files are opened on the executors; one that cannot be read gets a message instead
    of failing the job.  Paths are dealt to tasks by hash, contents never move.
    """
    tasks = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([*paths.schema.fields]).add("content", T.BinaryType()).add("message", T.StringType())
    return paths.repartition(tasks, "path").mapInArrow(_read_batches, schema)


def read_html_files(spark: SparkSession, paths: list[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole files as pages, any extension; see ``split_readable``.

    ``paths`` is a list or a table with a column ``path``; a folder stands for the files
    below it whose names, and whose folders' names, do not begin with ``_`` or ``.``; a
    file that is named is read whatever its name.  Empty files are empty pages; missing
    and unreadable ones become quarantine rows.
    """
    return split_readable(read_paths(listed_files(spark, paths)))


def stream_html_files(spark: SparkSession, dirs: list[str], max_files: int = 10_000) -> DataFrame:
    """Stream of new HTML files below ``dirs`` as a binary file table.

    One source over all folders of a file system, so a restart may watch other folders
    with the same checkpoint (a folder with pattern characters in its name is a source
    of its own and must stay).  Files of length 0 are not seen; they would score 0.
    """
    streams = [
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("pathGlobFilter", HTML_GLOB)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(glob)
        for glob in _globs(spark, dirs)
    ]
    files = streams[0]
    for stream in streams[1:]:
        files = files.unionByName(stream)
    return files


def _globs(spark: SparkSession, dirs: list[str]) -> list[str]:
    """Patterns that match exactly ``dirs``: one per file system, and one per odd name."""
    inside: dict[str, list[str]] = {}
    odd = []
    for path in dirs:
        uri = _status(spark, path).getPath().toUri()
        root, name = f"{uri.getScheme()}://{uri.getAuthority() or ''}/", uri.getPath().lstrip("/")
        escaped = re.sub(r"([\\{}\[\]*?,])", r"\\\1", name)
        if escaped == name:
            inside.setdefault(root, []).append(name)
        else:
            odd.append(root + escaped)
    return [root + "{" + ",".join(found) + "}" for root, found in sorted(inside.items())] + sorted(odd)


def changed_files(spark: SparkSession, dirs: list[str], ledger: DataFrame, since: str | None = None) -> DataFrame:
    """``path, modificationTime`` of the files that are not in the ledger like this.

    Compares listings only and writes the result down.  ``since`` (a timestamp
    string) skips older files while listing.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", HTML_GLOB)
        .option("recursiveFileLookup", "true")
    )
    if since is not None:
        reader = reader.option("modifiedAfter", since)
    files = reader.load(dirs).filter(is_html_path(F.col("path")))
    version = ["path", "modificationTime"]
    return stage(files.select(*version).join(ledger.select(*version), version, "left_anti"), "changed-files")


def rescan_modified(
    spark: SparkSession, dirs: list[str], ledger: DataFrame, since: str | None = None
) -> DataFrame:
    """Files whose ``(path, modificationTime)`` is not in the ledger, with their contents.

    A file stream reports each path once, so changed files need this batch pass.  No
    file is opened but those.
    """
    return read_paths(changed_files(spark, dirs, ledger, since))


def existing_dirs(spark: SparkSession, dirs: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(valid directories, (item, message) of the others).

    Of folders inside each other the outer one stays, so no file is found twice.
    """
    found, invalid = {}, []
    for path in dirs:
        status = _status(spark, path)
        if status is None:
            invalid.append((path, "not found"))
        elif not status.isDirectory():
            invalid.append((path, "not a directory"))
        else:
            found.setdefault(status.getPath().toString().rstrip("/") + "/", path)
    outer = [path for full, path in found.items() if not any(full != o and full.startswith(o) for o in found)]
    return outer, invalid


def exists(spark: SparkSession, path: str) -> bool:
    return _status(spark, path) is not None


def _status(spark: SparkSession, path: str):
    """File status from the file system the path names, or None."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(conf)
    return fs.getFileStatus(hadoop_path) if fs.exists(hadoop_path) else None


# Task code travels with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
