"""Ranks within groups and over all rows, without one task for a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored


def grouped_rank(df: DataFrame, groups: list[str], bucket: Column, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Adds the 1-based rank of a row in its group. ``bucket`` must not decrease in ``order``: rows are ranked inside buckets, and
    the buckets' counts, which are small, give the offset. So a group that holds a third of all rows is many windows."""
    df = df.withColumn("_b", bucket)
    counts = df.groupBy(*groups, "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    if total:
        counts = counts.withColumn(total, F.sum("_c").over(Window.partitionBy(*groups)))
    inner = Window.partitionBy(*groups, "_b").orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(inner)).join(counts.drop("_c"), [*groups, "_b"])
    return ranked.withColumn(name, (F.col("_r") + F.col("_before")).cast("long")).drop("_r", "_before", "_b")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ids from 0 in the order of columns that together are unique: range partitions, ranked each, offset by the counts before.

    The sorted rows are written with their places: ranges that are dealt twice, once for the rows and once for the counts, need not be the same,
    because the sizes that the planner merges ranges by depend on the columns that are read."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranked = stored(ranged, "dense-ids").withColumn("_p", F.shiftright("_at", 33))
    # One row for each range partition.
    sizes = ranked.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = sizes.withColumn("_o",
        F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(F.broadcast(offsets), "_p").withColumn(name, (place + F.col("_o")).cast("long")).drop("_p", "_at", "_o")
