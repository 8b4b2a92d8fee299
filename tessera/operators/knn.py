"""Exact top-k similarity joins.

Queries are written in blocks of bounded size to the shared folder, by the tasks that hold them; each task multiplies its part of the
corpus with one block after the other, and keeps k rows for each query and part (``Best``). A window over those few candidates merges the parts.
The corpus is never shuffled, and no query reaches the driver or a broadcast: only the blocks' names do.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import filesystem, make_folder, stored

#: Queries in a block; corpus bytes that meet the blocks at a time; bytes of blocks that a worker holds on to.
BLOCK_ROWS, PART_BYTES, HELD_BYTES = 4096, 32 << 20, 64 << 20
#: Corpus rows in a matrix product; candidates that are held before they are cut down to k a query, in multiples of k.
COLUMNS, HELD_TIMES = 512, 4
_held: OrderedDict[str, tuple[np.ndarray, ...]] = OrderedDict()


def candidates(k: int, corpus_size: int) -> int:
    """How many hits each query vector fetches."""
    return min(200, max(k, 10 * k), corpus_size)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and len(flat) % len(column) or len(set(column.value_lengths().to_pylist())) > 1:
        raise ValueError("all embeddings of a table must have the same length")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(rows: DataFrame) -> DataFrame:
    """Without null and empty embeddings, which nothing is like; those that stay in double precision."""
    return rows.withColumn("embedding", F.col("embedding").cast("array<double>")).where(F.size("embedding") > 0)


def block_files(queries: DataFrame, keys: tuple[str, ...], more: Callable[[np.ndarray], dict[str, np.ndarray]] = lambda v: {}) -> list[str]:
    """Writes the rows' keys (numbers) and embeddings in blocks, with ``more`` arrays of a block's embeddings; returns the files' names."""
    folder = make_folder(queries.sparkSession, "queries")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = filesystem(folder)
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                name = uuid.uuid4().hex  # a task that runs again writes files of its own; the table below says which count
                vectors = matrix(part.column("embedding"))
                with system.open_output_stream(f"{place}/{name}") as out:
                    np.savez(out, ids=np.stack([part.column(c).to_numpy() for c in keys], 1), vectors=vectors, **more(vectors))
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    rows = usable(queries).select(*[F.col(c).cast("long") for c in keys], "embedding")
    return [f"{folder}/{r['name']}" for r in stored(rows.mapInArrow(write, "name string"), "query-blocks").orderBy("name").collect()]


def block(path: str) -> tuple[np.ndarray, ...]:
    """Keys, vectors and what else was written of a block, from memory if the worker has read it lately."""
    if path not in _held:
        system, place = filesystem(path)
        with system.open_input_file(place) as f:
            x = np.load(f)
            _held[path] = tuple(x[name] for name in x.files)
        while sum(a.nbytes for arrays in _held.values() for a in arrays) > HELD_BYTES and len(_held) > 1:
            _held.popitem(last=False)
    _held.move_to_end(path)
    return _held[path]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a size: each part reads all blocks once."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.nbytes for x in held) >= PART_BYTES:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


class Best:
    """The k best corpus rows of each query of a block; ties go to the lower id. Scores come in matrices, of which only those are looked at
    closer that reach the query's k-th best so far, less what rounding to ``digits`` (none: not rounded) may add."""

    def __init__(self, queries: int, docs: np.ndarray, k: int, digits: int | None) -> None:
        self.docs, self.k, self.digits = docs, k, digits
        self.least = np.full(queries, np.finfo(np.float64).min)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count, self.limit = 0, HELD_TIMES * k * queries

    def _below(self, score: np.ndarray) -> np.ndarray:
        """What a score must reach so that it may be rounded to this one or more."""
        return score if self.digits is None else score - (10.0**-self.digits + 1e-15 * np.abs(score))

    def add(self, rows: np.ndarray, begin: int, scores: np.ndarray) -> None:
        """Scores of the queries ``rows`` with the corpus rows from ``begin`` on."""
        kept = (scores >= self.least[rows][:, None]) & (scores < np.inf)
        if scores.shape[1] > self.k and np.count_nonzero(kept) > self.k * len(rows):
            least = np.partition(np.where(kept, scores, -np.inf), -self.k, axis=1)[:, -self.k]
            self.least[rows] = np.maximum(self.least[rows], self._below(least))
            kept &= scores >= self.least[rows][:, None]
        r, c = np.divmod(np.flatnonzero(kept), scores.shape[1])
        s = scores[r, c]
        self.held.append((rows[r].astype(np.int64), c + begin, s if self.digits is None else np.round(s, self.digits) + 0.0))
        self.count += len(r)
        if self.count >= self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, corpus rows and scores that are left, by query and rank."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, col, score = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((self.docs[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        last = place == self.k - 1
        self.least[row[last]] = self._below(score[last])
        fine = place < self.k
        self.held = [(row[fine], col[fine], score[fine])]
        self.count = int(fine.sum())
        return self.held[0]


def knn(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", keys: tuple[str, ...] = ("query_id", "q_seg"),
        exclude: str | None = None, digits: int = 12) -> DataFrame:
    """The k best corpus rows for each query: keys, doc_id, label, score, rank.

    ``corpus`` has doc_id, label, embedding (and ``exclude``, a column whose value must differ from the first key). Cosine is the
    inner product of unit vectors, l2 the negated square distance. Scores are rounded to ``digits``; ties go to the lower doc_id. Rows with a
    null or empty embedding are left out; embeddings of several lengths are an error.
    """
    if metric not in ("cosine", "l2"):
        raise ValueError(f"unknown metric {metric!r}: cosine, l2")
    paths = block_files(queries, keys)
    corpus = usable(corpus.select("doc_id", "label", "embedding", *([exclude] if exclude else [])))
    label = corpus.schema["label"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            docs, c = b.column(0).to_numpy(), matrix(b.column(2))
            for path in paths:
                ids, q = block(path)
                best, every = Best(len(ids), docs, k, digits), np.arange(len(ids))
                for at in range(0, len(docs), COLUMNS):
                    own = c[at : at + COLUMNS]
                    s = q @ own.T
                    if metric == "l2":
                        s = -((q**2).sum(1)[:, None] + (own**2).sum(1)[None] - 2 * s)
                    if exclude:
                        s[b.column(3).slice(at, COLUMNS).to_numpy()[None] == ids[:, 0][:, None]] = -np.inf
                    best.add(every, at, s)
                row, col, score = best.cut()
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(ids[row, j]) for j in range(len(keys))], b.column(0).take(pa.array(col)),
                    b.column(1).take(pa.array(col)), pa.array(score)],
                    names=[*keys, "doc_id", "label", "score"])

    found = corpus.mapInArrow(work, ", ".join(f"{c} long" for c in keys) + f", doc_id long, label {label}, score double")
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def index_bytes(kind: str, n: int, dim: int, m: int = 32, pq_m: int = 16, nbits: int = 8) -> int:
    """What an index of n vectors would take."""
    if kind == "ivfpq":
        return n * pq_m * max(1, nbits // 8)
    return n * dim * 4 + (n * m * 8 if kind == "hnsw" else 0)
