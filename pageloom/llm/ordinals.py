"""Places in a global order, without sorting any group in one task."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.shared import stage


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "rows") -> DataFrame:
    """``rows`` plus ``position`` (from 0, in the order of ``order``) and ``total`` of their group.

    Rows are dealt by ranges of (group, order), so a group that holds a third of them lies
    in many tasks; each row gets its place in its task, and what the earlier tasks hold of
    its group is added.  The table of counts has a row per task and group in it.  Null
    group keys are a group, nulls come first in any order; rows equal in all of ``order``
    get their places in any order.  ``rows`` is read twice and should be a written table.
    """
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    placed = stage(ranged.withColumn("place", F.monotonically_increasing_id()), f"{name}-placed")
    placed = placed.withColumn("part", F.shiftrightunsigned("place", 33).cast("int"))
    held = placed.groupBy(*group, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    held = stage(held, f"{name}-counts")
    counts = held.toDF(*[f"of_{key}" for key in group], "of_part", "first", "n")
    keys = [F.col(f"of_{key}") for key in group]
    if group:
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1))
        total = F.sum("n").over(Window.partitionBy(*keys))
    else:  # a row per task, so the constant key holds few rows
        before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1))
        total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    offsets = counts.select("*", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))
    same = F.col("part") == F.col("of_part")
    for key in group:
        same = same & F.col(key).eqNullSafe(F.col(f"of_{key}"))
    joined = placed.join(offsets, same)
    return joined.select(
        *rows.columns, (F.col("place") - F.col("first") + F.col("before")).alias("position"), "total")
