"""Page snapshot tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``url, html`` of a parquet snapshot; other columns are not read."""
    return spark.read.parquet(path).select("url", "html")


def seeds(urls: DataFrame, url: str = "url") -> DataFrame:
    """Seed table ``url, priority, depth``."""
    return urls.select(
        F.col(url).alias("url"), F.lit(1.0).alias("priority"), F.lit(0).alias("depth")
    )


def write_snapshot(pages: DataFrame, table: str, buckets: int) -> None:
    """Save pages bucketed by url, so later joins on url read without a shuffle."""
    pages.write.bucketBy(buckets, "url").sortBy("url").mode("overwrite").saveAsTable(table)
