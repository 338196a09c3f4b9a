"""What the operators of this subpackage share: staging, batches, graph components."""

import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session without that setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="pageloom-llm-")
        return _LOCAL_FOLDERS[app]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/pageloom-llm-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written table.

    The lineage ends there: a lost executor costs a reread, not a recomputation.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_hash(doc_id: Column, text: Column) -> Column:
    """A long that tells rows apart that share a doc_id.

    Any number of rows may have no doc_id, so there it has 64 bits; 32, which take half
    the room in shuffles, are enough among the few rows that repeat an id.
    """
    return F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.hash(text))


def same_row(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality on ``columns``, so rows with null ids keep their results."""
    condition = F.lit(True)
    for name in columns:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def binary_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column as the UTF-8 bytes it holds, without decoding them."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def per_batch(
    build: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lift a function of one batch to the iterator form of ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from build(batch)

    return run


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def span_list(spans: list[tuple[str, int, int]]) -> str:
    """``kind:start:end`` joined by commas, in the order given."""
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: columns ``node``, ``root``.

    ``edges`` has two long columns ``a`` and ``b``; ``root`` is the smallest node
    that can be reached.  Nodes without an edge to another node are not listed.

    Alternating large-star and small-star steps; every step is an equi-join and
    an aggregation that combines before its shuffle, so a node with very many
    neighbours is split by the skew handling of the join, and no adjacency list is
    ever built.  Each round is written to the shared folder.
    """
    current = stage(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u > v").distinct(),
        "edges",
    )
    seen = _edge_digest(current)
    while seen[0]:
        lowest = (
            current.select("u", "v").union(current.select("v", "u"))
            .groupBy("u").agg(F.min("v").alias("m"))
            .select(F.col("u").alias("hub"), F.least("u", "m").alias("m"))
        )
        large = (
            current.join(lowest, F.col("v") == F.col("hub")).select("u", F.col("m").alias("v"))
        )
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "hub")
        small = large.join(least, F.col("u") == F.col("hub")).select("u", "v", "m")
        following = stage(
            small.select("u", F.col("m").alias("v"))
            .union(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .distinct(),
            "edges",
        )
        digest = _edge_digest(following)
        current = following
        if digest == seen:
            break
        seen = digest
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.union(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _edge_digest(edges: DataFrame) -> tuple:
    """Count and order-free digest; equal digests mean that nothing changed."""
    mixed = F.xxhash64("u", "v")
    row = edges.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(mixed), F.lit(0)).alias("x"),
        F.coalesce(F.sum(F.shiftrightunsigned(mixed, 40)), F.lit(0)).alias("s"),
    ).first()
    return tuple(row)


# Task code travels with the plan, so executors need nothing installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
