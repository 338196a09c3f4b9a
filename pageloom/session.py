"""Session settings that suit these workloads."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # parsing costs far more per byte than reading: keep small stages parallel
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    # pages go to Python in batches of bounded bytes, whatever their number
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # call sites per column expression cost a driver round trip each
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
