"""Questions of text blocks to shards of hashes, and the answers.

Blocks of texts are files in the shared folder. A block sends what it knows of its distinct hashes to the shards that they belong to, in
cells: one row for each block and shard, with packed arrays in the order of the hash. A shard sums up its cells and answers each in
the same order. So a hash that a third of all documents have is one entry a block, and no row is ever one document's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb

#: Rows for blocks: ``order`` tells the round that ``cell`` answers (0: no answer, the block itself).
TO_BLOCK = "block long, `order` int, shard long, cell binary"


def packed(values: np.ndarray) -> bytes:
    """Numbers in little space: bytes of equal weight together."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def unpacked(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def cuts(keys: np.ndarray, shards: int) -> tuple[np.ndarray, list[slice]]:
    """Shards of sorted 64-bit hashes (ranges of them), and where each one's hashes stand."""
    shard = ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
    numbers, start = np.unique(shard, return_index=True)
    edge = [*start.tolist(), len(keys)]
    return numbers.astype(np.int64), [slice(i, j) for i, j in zip(edge, edge[1:], strict=False)]


def cells(block: int, keys: np.ndarray, facts: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """A block's rows for the shards: its sorted hashes, and what it knows of each."""
    numbers, places = cuts(keys, shards)
    columns = [pa.array([packed(np.diff(keys[c], prepend=np.uint64(0))) for c in places], pa.binary())]
    columns += [pa.array([packed(x[c]) for c in places], pa.binary()) for x in facts]
    return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.full(len(places), block)), *columns],
        names=["shard", "block", "keys", *[f"f{k}" for k in range(len(facts))]])


def cell_schema(facts: int) -> str:
    return "shard long, block long, keys binary" + "".join(f", f{k} binary" for k in range(facts))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]]]]:
    """Rows of (block, order, cell) come sorted: one block at a time, with its cells by order."""
    now, held = None, {}
    for b in batches:
        for block, order, cell in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
            if block != now and now is not None:
                yield now, held
                held = {}
            now = block
            if order:
                held.setdefault(order, []).append(cell)
    if now is not None:
        yield now, held
    tb.release()


def whole_blocks(blocks: DataFrame, answers: list[DataFrame], n_blocks: int) -> DataFrame:
    """Blocks with all answers so far, dealt for ``by_block``."""
    rows = blocks.select("block", F.lit(0).alias("order"), F.lit(-1).cast("long").alias("shard"), F.lit(None).cast("binary").alias("cell"))
    for a in answers:
        rows = rows.union(a)
    return rows.repartition(max(1, n_blocks), "block").sortWithinPartitions("block", "order", "shard").select("block", "order", "cell")


def answered(asked: DataFrame, facts: list[type], shards: int, order: int, answer: Callable) -> DataFrame:
    """Each shard's answers: rows of ``TO_BLOCK``, and a row of null block with a total.

    ``answer(keys, at, blocks, facts)`` gets a shard's distinct hashes, the place among them of each entry, the entry's block, and its
    facts; it returns an array for the entries, and the shard's total."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, rows: list[tuple]) -> pa.RecordBatch:
            keys = [np.cumsum(unpacked(r[1], np.uint64), dtype=np.uint64) for r in rows]
            known = [np.concatenate([unpacked(r[2 + k], kind) for r in rows]) for k, kind in enumerate(facts)]
            size = list(map(len, keys))
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            out, total = answer(distinct, at, np.repeat(np.array([r[0] for r in rows]), size), known)
            edge, n = np.cumsum([0, *size]), len(rows)
            parts = [packed(out[i:j].copy()) for i, j in zip(edge, edge[1:], strict=False)]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows] + [None], pa.int64()), pa.array([order] * (n + 1), pa.int32()), pa.array([shard] * (n + 1), pa.int64()),
                pa.array([*parts, None], pa.binary()), pa.array([None] * n + [total], pa.int64())],
                names=["block", "order", "shard", "cell", "total"])

        now, rows = None, []
        for b in batches:
            for shard, *row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if shard != now and rows:
                    yield done(now, rows)
                    rows = []
                now = shard
                rows.append(row)
        if rows:
            yield done(now, rows)
        tb.release()

    dealt = asked.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(work, TO_BLOCK + ", total long")
