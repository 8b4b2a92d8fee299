"""Benchmark decontamination with an FM-index per shard of the training texts.

A shard is a slice of documents. Its words that no benchmark item has can't be in an occurrence; they part the texts, as
do document borders, and runs shorter than the shortest window go. Over what is left, an FM-index is built: suffix order by
prefix doubling, the Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All windows of the benchmark
are searched backwards at once; their occurrences are located by walking to sampled positions, and merged into
removal spans.

Scale: documents aren't shuffled. The benchmark's windows are compiled in blocks of bounded size, written to the shared folder,
and read by the tasks one block at a time, so that a benchmark of any size needs bounded memory and nothing is broadcast.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import filesystem, keyed_blocks, work_path

#: Words in a window; bytes of benchmark text in a block; of documents in a shard; every so many positions the suffix array is kept.
WINDOW, BLOCK_BYTES, SHARD_BYTES, SAMPLE = 10, 16 << 20, 2 << 20, 8


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words (runs of digits, letters and non-ASCII; A-Z lower-cased), and each text's first."""
    low = tb.lower_ascii(raw)
    inside = ((low - np.uint8(0x30)) < 10) | ((low - np.uint8(0x61)) < 26) | (low >= 0x80)
    starts, ends, first = tb.runs(inside, offsets)
    return starts, ends, tb.span_hashes(tb.prefix_sums(low), starts, ends), first


class WaveletMatrix:
    """Rank over a sequence of small integers."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        at = symbols
        for k in range(self.bits - 1, -1, -1):
            bit = (at >> k) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(at) - int(self.ones[-1][-1]))
            at = np.concatenate([at[bit == 0], at[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before ``end``."""
        low, high = np.zeros(len(symbol), np.int64), end
        for level, k in enumerate(range(self.bits - 1, -1, -1)):
            ones, bit = self.ones[level], ((symbol >> k) & 1).astype(bool)
            low = np.where(bit, self.zeros[level] + ones[low], low - ones[low])
            high = np.where(bit, self.zeros[level] + ones[high], high - ones[high])
        return high - low

    def access(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``place``, and how often it stands before it."""
        symbol, low, at = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), place
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[at + 1] > ones[at]
            at = np.where(bit, self.zeros[level] + ones[at], at - ones[at])
            low = np.where(bit, self.zeros[level] + ones[low], low - ones[low])
            symbol = symbol * 2 + bit
        return symbol, at - low


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; zeros are borders, each of its own."""
    n = len(codes)
    rank = codes.astype(np.int64) + n
    border = np.flatnonzero(codes == 0)
    rank[border] = np.arange(len(border))
    _, rank = np.unique(rank, return_inverse=True)
    step = 1
    while True:
        later = np.zeros(n, np.int64)
        later[:-step or None] = rank[step:] + 1 if step < n else 0
        key = rank * (n + 1) + later
        order = np.argsort(key, kind="stable")
        change = np.empty(n, np.int64)
        change[0] = 0
        change[1:] = np.cumsum(key[order[1:]] != key[order[:-1]])
        rank[order] = change
        if change[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    """Backward search and location over codes that begin and end with 0 and have 0 between runs."""

    def __init__(self, codes: np.ndarray, sigma: int) -> None:
        order = suffix_order(codes)
        self.n = len(codes)
        self.wavelet = WaveletMatrix(codes[order - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=sigma))]).astype(np.int64)
        # A walk goes back within a run only: each run's first place is kept as well.
        keep = (order % SAMPLE == 0) | (codes[order - 1] == 0)
        self.kept = np.where(keep, order, -1)

    def search(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffix array that begin with each window (padded with zeros at its end)."""
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            live = np.flatnonzero((k < lengths) & (low < high))
            c = windows[live, k]
            low[live] = self.smaller[c] + self.wavelet.rank(c, low[live])
            high[live] = self.smaller[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of suffix array rows."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            found = self.kept[at[todo]]
            done = found >= 0
            out[todo[done]] = found[done] + steps[todo[done]]
            todo = todo[~done]
            symbol, before = self.wavelet.access(at[todo])
            at[todo] = self.smaller[symbol] + before
            steps[todo] += 1
        return out


class Phrases:
    """A block of benchmark windows: vocabulary, windows as codes, and the items of each window."""

    def __init__(self, vocabulary: np.ndarray, windows: np.ndarray, lengths: np.ndarray, of: np.ndarray,
            items: np.ndarray, names: np.ndarray) -> None:
        self.vocabulary, self.windows, self.lengths, self.of, self.items, self.names = vocabulary, windows, lengths, of, items, names
        self.likely = np.zeros(1 << 18, bool)
        self.likely[(vocabulary >> np.uint64(46)).astype(np.int64)] = True

    @classmethod
    def compiled(cls, ids: list[str], texts: list[str], window: int) -> Phrases:
        raw, offsets = tb.buffers(pa.array(texts, pa.string()))
        _, _, hashes, first = words_of(raw, offsets)
        vocabulary, codes = np.unique(hashes, return_inverse=True)
        codes = codes.astype(np.int64) + 1
        names, item_of = np.unique(np.array(ids, dtype=object).astype(str), return_inverse=True)
        rows, items = [], []
        for k in range(len(ids)):
            own = codes[first[k] : first[k + 1]]
            if len(own) >= window:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, window))
            elif len(own):
                rows.append(np.pad(own, (0, window - len(own)))[None])
            items += [item_of[k]] * (len(rows[-1]) if len(own) else 0)
        every = np.concatenate(rows) if rows else np.zeros((0, window), np.int64)
        distinct, of = np.unique(every, axis=0, return_inverse=True) if len(every) else (every, np.zeros(0, np.int64))
        pairs = np.unique(np.stack([of.reshape(-1), np.array(items, np.int64)], 1), axis=0) if len(every) else np.zeros((0, 2), np.int64)
        starts = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        return cls(vocabulary, distinct, (distinct > 0).sum(1), starts, pairs[:, 1], names.astype(str))

    def saved(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, v=self.vocabulary, w=self.windows, n=self.lengths, o=self.of, i=self.items, s=self.names)
        return out.getvalue()

    @classmethod
    def loaded(cls, raw: bytes) -> Phrases:
        x = np.load(io.BytesIO(raw))
        return cls(x["v"], x["w"], x["n"], x["o"], x["i"], x["s"])

    def occurrences(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows occur among a shard's words: first words and windows."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.windows) or not len(hashes):
            return none
        maybe = np.flatnonzero(self.likely[(hashes >> np.uint64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes[maybe]
        places, codes = maybe[known], at[known] + 1
        if not len(places):
            return none
        doc = np.searchsorted(first, places, "right")
        new = np.concatenate([[True], (np.diff(places) != 1) | (np.diff(doc) != 0)])
        begin = np.flatnonzero(new)
        size = np.diff(np.concatenate([begin, [len(places)]]))
        keep = np.repeat(size >= self.lengths.min(), size)
        places, codes, new = places[keep], codes[keep], new[keep]
        if not len(places):
            return none
        # A zero before each run, and one at the end.
        shift = np.arange(len(places)) + np.cumsum(new)
        text = np.zeros(int(shift[-1]) + 2, np.int64)
        text[shift] = codes
        back = np.zeros(len(text), np.int64)
        back[shift] = places
        index = FMIndex(text, len(self.vocabulary) + 1)
        low, high = index.search(self.windows, self.lengths)
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        return back[index.locate(rows)], which


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  keep: list[str] | None = None, cleaned: bool = True) -> DataFrame:
    """Each document's words, words inside occurrences of benchmark windows, the items with occurring windows, and its text without them.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Returns the columns ``keep`` (the id
    alone by default), n_words, n_hit, items (sorted array of item ids as strings) and, if asked for, cleaned (the text
    without its merged spans, each from its first word's start to its last word's end).

    Defined cases: null texts have no words; items without words, or with a null id, have no windows; equal windows of many
    items count for all of them; repeated ids are kept row by row; empty tables give no rows, or no hits; columns not in
    ``keep`` are left out.
    """
    spark = docs.sparkSession
    keep = keep or [id_col]
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t")).where("i is not null")
    blocks = keyed_blocks(items.agg(F.sum(F.octet_length("t"))).first()[0], BLOCK_BYTES)
    folder = work_path(spark, "phrases")
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    paths = []
    for k in range(blocks):  # each of bounded size
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        with system.open_output_stream(f"{base}/{k}") as out:
            out.write(Phrases.compiled([r["i"] for r in rows], [r["t"] for r in rows], window).saved())
        paths.append(f"{folder}/{k}")

    def load(path: str) -> Phrases:
        inner, name = filesystem(path)
        with inner.open_input_stream(name) as f:
            return Phrases.loaded(f.read())

    source = docs.select(*keep, F.col(text_col).alias("_whole"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    names = [*keep, "n_words", "n_hit", "items", *["cleaned"] * cleaned]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = load(paths[0]) if len(paths) == 1 else None
        for batch in batches:
            for part in tb.slices(batch, "_whole", SHARD_BYTES):
                column = part.column(len(keep))
                raw, offsets = tb.buffers(column)
                starts, ends, hashes, first = words_of(raw, offsets)
                n_docs, n_words = part.num_rows, len(starts)
                edge = np.zeros(n_words + 1, np.int64)
                found: list[set[str]] = [set() for _ in range(n_docs)]
                for path in paths:
                    block = only or load(path)
                    at, which = block.occurrences(hashes, first)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + block.lengths[which], -1)
                    doc = np.searchsorted(first, at, "right") - 1
                    for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                        found[d].update(block.names[block.items[block.of[w] : block.of[w + 1]]].tolist())
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                out = [*part.columns[: len(keep)], pa.array(np.diff(first), pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([sorted(x) for x in found], pa.list_(pa.string()))]
                if cleaned:
                    texts = column.fill_null("").to_pylist()
                    for d in np.flatnonzero(n_hit).tolist():
                        a, b = int(offsets[d]), int(offsets[d + 1])
                        turn = np.diff(np.concatenate([[0], hit[first[d] : first[d + 1]].astype(np.int8), [0]]))
                        begin, stop = np.flatnonzero(turn == 1) + first[d], np.flatnonzero(turn == -1) - 1 + first[d]
                        gone = np.zeros(b - a + 1, np.int64)
                        gone[starts[begin] - a] += 1
                        gone[ends[stop] - a] -= 1
                        texts[d] = raw[a:b][np.cumsum(gone[:-1]) == 0].tobytes().decode()
                    out.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return source.mapInArrow(work, f"{schema}, n_words long, n_hit long, items array<string>" + ", cleaned string" * cleaned)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), cleaned=False)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH low AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT low.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low LEFT JOIN covered ON low.doc_id = covered.doc_id LEFT JOIN found ON low.doc_id = found.doc_id
"""
