"""Stratified samples and splits by hash order: no random generator, so results don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grouping import grouped_rank


def _ranked(df: DataFrame, key: str, label: str, total: str | None = None) -> DataFrame:
    digest = F.md5(F.col(key).cast("string"))
    return grouped_rank(df.withColumn("_h", digest), [label], F.substring("_h", 1, 3), [F.col("_h"), F.col(key)], "_rank", total).drop("_h")


def stratified_split(df: DataFrame, key: str, label: str, ratio: float = 0.2) -> DataFrame:
    """Adds part: of a label's n rows ``max(1, min(round(n * ratio), n - 1))`` are test (halves to even), none of a single one."""
    ranked = _ranked(df, key, label, "_n")
    n_test = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * ratio, 0).cast("long"), F.col("_n") - 1))
    part = F.when((F.col("_n") > 1) & (F.col("_rank") <= n_test), "test").otherwise("train")
    return ranked.withColumn("part", part).drop("_rank", "_n")


def stratified_sample(df: DataFrame, key: str, label: str, size: int) -> DataFrame:
    """``size`` rows: one of each label, then round-robin. The order is (rank in label, hash of label)."""
    ranked = _ranked(df, key, label)
    return ranked.orderBy("_rank", F.md5(F.col(label).cast("string")), key).limit(size).drop("_rank")
