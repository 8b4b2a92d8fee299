"""Small helpers that several corpus operators need."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import discard, filesystem, make_folder, scratch, shared_dir, stored, work_path

__all__ = [
    "components", "discard", "filesystem", "get_arrays", "keyed_blocks", "lower_ascii", "make_folder", "put_arrays", "scratch",
    "shared_dir", "stored", "work_path",
]

#: A-Z, and what they become; other letters stay as they are.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def put_arrays(path: str, **arrays: np.ndarray) -> None:
    """Writes arrays as one compressed file, under its name only when complete."""
    system, name = filesystem(path)
    out = io.BytesIO()
    np.savez(out, **arrays)
    part = f"{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part, compression=None) as f:
        f.write(zstandard.ZstdCompressor(level=1).compress(out.getbuffer()))
    system.move(part, name)


def get_arrays(path: str):
    system, name = filesystem(path)
    with system.open_input_stream(name, compression=None) as f:
        return np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(f.read())))


def keyed_blocks(n_bytes: int, target: int, least: int = 1) -> int:
    """How many blocks of about ``target`` bytes hold ``n_bytes``."""
    return max(least, -(-int(n_bytes or 0) // target))


#: Edges that one task takes at a time; more of them are joined in rounds.
TASK_EDGES = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task, each node with the least one."""
    root: dict = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(x, x)), find(root.setdefault(y, y))
            if x != y:
                root[max(x, y)] = min(x, y)
    if root:
        yield pa.RecordBatch.from_arrays([pa.array(list(root), kind), pa.array([find(x) for x in root], kind)], names=["node", "label"])


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of the columns a and b: a row (node, label) for each node that has an edge; label is the least node.

    Up to ``TASK_EDGES`` edges (counted) are joined in one task. More of them aren't brought together: labels spread along edges and by pointer
    jumping, a written table a round, until none changes; the number of rounds is about the logarithm of the longest path. Nothing but
    the count of changes reaches the driver.
    """
    spark, old = edges.sparkSession, set()
    once = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    if once.count() <= TASK_EDGES:
        kind = edges.schema["a"].dataType.simpleString()
        return stored(once.coalesce(1).mapInArrow(_forest, f"node {kind}, label {kind}"), f"{name}-labels")
    both = once.union(once.select("b", "a")).toDF("a", "b")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = step.join(jump, "low", "left").select("node", F.least("low", "far").alias("label"),
            (F.least("low", "far") != F.col("label")).alias("changed"))
        path = work_path(spark, f"{name}-labels")
        new.write.parquet(path)
        discard(old)  # the labels of the round before
        old, new = {path}, spark.read.schema(new.schema).parquet(path)
        labels = new.select("node", "label")
        if new.where("changed").isEmpty():
            return labels
