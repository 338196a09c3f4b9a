"""Cutting lineage between the stages of a job."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_FOLDERS: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The shared folder of the cluster; one temporary folder per session in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="pageloom-")
        return _LOCAL_FOLDERS[app]
    raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark)}/pageloom-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Later stages read files instead of recomputing, also after lost executors.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
