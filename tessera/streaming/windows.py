"""Windows over streams (an extension: the batch windows in event time, with late data dropped by a watermark)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, size: str, hop: str | None = None, late: str = "1 hour") -> DataFrame:
    """ts, event_type, value -> window start, event_type, n, total: tumbling, or sliding with ``hop``."""
    window = F.window("ts", size, hop) if hop else F.window("ts", size)
    return stream.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count("*").alias("n"),
        F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def search_stream(queries: DataFrame, search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Searches each micro-batch of query vectors in a static corpus and appends the hits to a table, each batch once."""

    def batch(df: DataFrame, epoch: int) -> None:
        search(df).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return queries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
