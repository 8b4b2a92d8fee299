"""Removal of repeated byte strings with suffix arrays and longest previous factors.

Every window of ``LENGTH`` bytes has an anchor, the place of its least hash of ``GRAM`` bytes (the last, at a tie): windows of equal
bytes have equal anchors at equal places in them. A context is a run of windows of one anchor, and its core what all of them have in
common; windows can only be equal in contexts of equal cores. Contexts are halved once, so that cores have 116 bytes; a core that
occurs once ends there, and one whose contexts are all equal is a plain copy. Contexts of a core that differ meet in one suffix array, in the
order of their first occurrence; from neighbours' common prefixes, previous and next smaller positions give each window's
longest previous factor: one of ``LENGTH`` bytes is a later copy. A core with over ``MEET`` contexts is too much for a task: its
contexts are halved again, and so on, with longer and longer cores (at last the window itself, whose contexts are all equal).

Scale: texts are never shuffled, but for the contexts that meet. They are written once, in blocks, to the shared folder; blocks ask the shards
of the cores' hashes, one entry for each block and core, so that a core of a third of all documents is no hot key.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .exchange import TO_BLOCK, answered, by_block, cell_schema, cells, unpacked, whole_blocks
from .shared import get_arrays, make_folder, put_arrays, stored

#: Bytes of a repeated string; of an anchor's hash; most contexts of a core that meet; bytes in a suffix array; in a block.
LENGTH, GRAM, MEET, ARRAY_BYTES, BLOCK_BYTES = 200, 32, 4096, 256 << 10, 2 << 20
#: Bytes of text that are worked on at a time; cores that meet in a shard, as an upper bound of the mean.
CACHE_BYTES, SHARD_KEYS = 1 << 20, 1_000_000
#: Places within a text are told apart by so many bits when hashes are equal.
_PLACE_BITS = 28
#: What a shard answers on a core: it is repeated; its contexts differ; they are too many to meet; the block has its first context.
REPEATED, DIFFER, MANY, FIRST = 1, 2, 4, 8
#: Flags of contexts come back to blocks as rows of this order and more.
_FLAGS = 1000


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of ``length`` bytes that don't cross documents: place, gram hash, first and last window start."""
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(raw)
    if n < length:
        return none
    hashes = tb.gram_hashes(raw, gram)
    mask = np.uint64((1 << _PLACE_BITS) - 1)
    key = (hashes & ~mask) | (mask - (np.arange(len(hashes), dtype=np.uint64) & mask))
    width = length - gram + 1
    m = len(key)
    padded = np.full(-(-m // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(m - width + 1)
    least = np.minimum(back[: m - width + 1], ahead[width - 1 : m])
    place = (mask - (least & mask)).astype(np.int64)
    place += (starts - place + int(mask)) >> _PLACE_BITS << _PLACE_BITS
    doc = np.repeat(np.arange(1, len(offsets)), np.diff(offsets))[: len(starts)]
    ok = starts + length <= offsets[doc]
    starts, place, doc = starts[ok], place[ok], doc[ok]
    if not len(starts):
        return none
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return place[first], hashes[place[first]], starts[first], starts[last]


def block_anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """The anchors of a block, worked out for a few documents at a time, so that the tables fit the processor's cache."""
    parts, start, n = [], 0, len(offsets) - 1
    while start < n:
        stop = min(max(int(np.searchsorted(offsets, offsets[start] + CACHE_BYTES, "right")) - 1, start + 1), n)
        lo, hi = offsets[start], offsets[stop]
        place, hashes, first, last = anchors(raw[lo:hi], offsets[start : stop + 1] - lo, length, gram)
        parts.append((place + lo, hashes, first + lo, last + lo))
        start = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else anchors(raw, offsets, length, gram)


def suffix_array(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at ``starts`` in the order of their first ``length`` bytes, ties by place; and how many bytes each has in common
    with the one before, ``length`` at most. By prefix doubling over all places, from 8 bytes on."""
    n = len(raw)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n]
    have = min(8, length)
    if length < 8:
        word >>= np.uint64(8 * (8 - length))

    def named(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ahead = key[order]
        out = np.empty(n, np.int64)
        out[order] = np.concatenate([[0], np.cumsum(ahead[1:] != ahead[:-1])])
        return out

    rank, levels = named(word), []
    while have < length:
        levels.append((have, rank.astype(np.int32)))
        step = min(have, length - have)
        later = np.zeros(n, np.int64)
        later[:-step] = rank[step:] + 1
        rank = named(rank * (n + 1) + later)
        have += step
    own = rank[starts]
    order = np.argsort(own, kind="stable")
    p, q = starts[order[:-1]], starts[order[1:]]
    common = np.zeros(len(p), np.int64)
    for size, names in reversed(levels):
        a, b = p + common, q + common
        inside = np.maximum(a, b) < n
        a, b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        common += np.where(inside & (names[a] == names[b]), size, 0)
    odd = word[np.minimum(p + common, n - 1)] ^ word[np.minimum(q + common, n - 1)]
    for k in range(1, min(8, length)):
        common += (odd >> np.uint64(8 * (min(8, length) - k))) == 0
    common = np.minimum(np.where(own[order[1:]] == own[order[:-1]], length, common), length)
    return order, np.concatenate([[0], common])


def _nearest_smaller(place: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What each suffix has in common with the nearest one before it, in suffix order, whose place is smaller (0: there is none). Suffixes
    that are passed on the way point further, so that ways shorten by jumps."""
    previous, low = np.arange(-1, len(place) - 1), common.copy()
    todo = np.flatnonzero((previous >= 0) & (low > 0))
    while len(todo):
        todo = todo[place[previous[todo]] > place[todo]]
        past = previous[todo]
        low[todo] = np.minimum(low[todo], low[past])
        previous[todo] = previous[past]
        todo = todo[(previous[todo] >= 0) & (low[todo] > 0)]
    low[previous < 0] = 0
    return low


def previous_factors(raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at ``starts`` (ascending): the longest previous factor, of ``length`` bytes at most; and whether any other suffix has the
    same ``length`` bytes."""
    order, common = suffix_array(raw, starts, length)
    before = _nearest_smaller(order, common)
    after = _nearest_smaller(order[::-1], np.concatenate([[0], common[:0:-1]]))[::-1]
    factor, twice = np.empty(len(order), np.int64), np.zeros(len(order), bool)
    factor[order] = np.maximum(before, after)
    twice[order] = (common == length) | (np.append(common[1:], 0) == length)
    return factor, twice


def repeated(contexts: list[bytes], windows: list[int], length: int = LENGTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For contexts in the order of their first occurrence: which of their windows stand in another one, and in an earlier one."""
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    begin = np.cumsum([0, *map(len, contexts)])[:-1]
    count = np.array(windows)
    which = np.repeat(np.arange(len(contexts)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    factor, twice = previous_factors(raw, begin[which] + offset, length)
    edge = np.cumsum(count)[:-1]
    return np.split(twice, edge), np.split(factor >= length, edge)


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Row batches regrouped so that equal neighbours in an integer column (never null) are in one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(column).to_numpy()
        if held and keys[0] != held[-1].column(column)[-1].as_py():
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
        cut = np.flatnonzero(keys[1:] != keys[:-1])
        last = int(cut[-1]) + 1 if len(cut) else 0
        if last:
            yield pa.concat_batches([*held, b.slice(0, last)])
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.concat_batches(held)


class Contexts:
    """A block's contexts of one round: anchor's place, first window, number of windows, the range of the anchor's places in a window, hashes
    of core and context, and the text they stand in."""

    def __init__(self, place, begin, count, low, high, doc, raw: np.ndarray | None, key=None, length: int = LENGTH) -> None:
        self.place, self.begin, self.count, self.low, self.high, self.doc, self.key, self.ctx = place, begin, count, low, high, doc, key, None
        if raw is not None:
            sums = tb.prefix_sums(raw)
            self.key = tb.mix(tb.span_hashes(sums, place - low, place + length - high) + low.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            self.ctx = tb.mix(tb.span_hashes(sums, begin,
                begin + count - 1 + length) + (place - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def halved(self, chosen: np.ndarray, raw: np.ndarray, length: int) -> Contexts:
        """The chosen contexts in two parts each: windows with the anchor further on in them, and the others."""
        place, begin, count, low, high, doc = (x[chosen] for x in (self.place, self.begin, self.count, self.low, self.high, self.doc))
        middle, last = (low + high + 1) // 2, begin + count - 1
        parts = []
        for a, b in ((middle, high), (low, middle - 1)):
            first, stop = np.maximum(begin, place - b), np.minimum(last, place - a)
            ok = stop >= first
            parts.append([x[ok] for x in (place, first, stop - first + 1, a, b, doc)])
        return Contexts(*[np.concatenate(x) for x in zip(*parts, strict=True)], raw, length=length)

    def summed(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Contexts sorted by core, text id and place; where each core begins among them; facts of each core for its shard; its distinct contexts."""
        d = ids[self.doc]
        order = np.lexsort((self.begin, d, self.key))
        key, ctx = self.key[order], self.ctx[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        by_ctx = np.lexsort((ctx, group))
        g, c = group[by_ctx], ctx[by_ctx]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])]) if len(g) else np.zeros(0, bool)
        kinds = np.bincount(g[new], minlength=len(start)).astype(np.uint32)
        size = np.diff(np.append(start, len(key)))
        least = np.minimum.reduceat(ctx, start) if len(start) else ctx
        most = np.maximum.reduceat(ctx, start) if len(start) else ctx
        return order, start, [size.astype(np.uint32), kinds, least, most, d[order][start], self.begin[order][start].astype(np.int32)], group


#: The kinds of a core's facts.
FACTS = [np.uint32, np.uint32, np.uint64, np.uint64, np.int64, np.int32]


class Block:
    """A block of texts, and what the shards answered on its contexts, round by round."""

    def __init__(self, path: str, length: int, gram: int) -> None:
        self.path, self.length = path, length
        x = get_arrays(f"{path}.anchors")
        zero = np.zeros(len(x["p"]), np.int64)
        self.ids = x["ids"]
        self.anchors = Contexts(x["p"].astype(np.int64), x["p"] - x["a"].astype(np.int64), x["w"].astype(np.int64), zero,
            zero + (length - gram), x["owner"].astype(np.int64), None, x["key"])
        self.texts = None
        self.rounds: list[tuple] = []

    def text(self):
        if self.texts is None:
            self.texts = get_arrays(self.path)
            self.raw = self.texts["raw"]
        return self.texts

    def known(self, answers: dict[int, list[bytes]], rounds: int) -> Block:
        """Goes through rounds 1 to ``rounds`` - 1, of which the answers are known, and prepares the last one."""
        self.text()
        keys = np.unique(self.anchors.key)
        twice = np.concatenate([unpacked(c, np.uint8) for c in answers[1]]).astype(bool) if 1 in answers else np.zeros(0, bool)
        chosen = twice[np.searchsorted(keys, self.anchors.key)] if len(keys) else np.zeros(0, bool)
        now = self.anchors
        for k in range(2, rounds + 1):
            now = now.halved(chosen, self.raw, self.length)
            order, start, facts, group = now.summed(self.ids)
            said = np.concatenate([unpacked(c, np.uint8) for c in answers[k]]) if k in answers else np.zeros(len(start), np.uint8)
            self.rounds.append((now, order, start, facts, said[group]))
            chosen = np.zeros(len(now.key), bool)
            chosen[order] = said[group] & MANY > 0
        return self


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "first", columns: list[str] | None = None,
          length: int = LENGTH, gram: int = GRAM, meet: int = MEET, cleaned: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Removes the bytes of repeated strings of ``length`` bytes, judged on the input, and never across documents.

    ``keep="first"`` keeps the first occurrence (by id, then block and place); ``keep="none"`` removes all. Returns the columns
    ``columns`` (the id alone by default), n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes that stay) and,
    if asked for, cleaned (the text that stays; parts of characters at a cut go).

    Defined cases: null texts are empty; texts of fewer than ``length`` bytes stay; a text longer than a block is a block of its own; rows of
    null id come first; ids that aren't whole numbers are in the order of a hash of them; repeated rows are copies of each other; one text
    that repeats within itself counts; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    columns = columns or [id_col]
    folder = make_folder(spark, "suffix")
    whole_number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    ordered = F.col(id_col).cast("long") if whole_number else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col))
    rows = docs.select(*columns, ordered.alias("_d"), F.col(text_col).alias("_t"))

    def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.slices(b, "_t", block_bytes):
                raw, offsets = tb.buffers(part.column(len(columns) + 1))
                block = uuid.uuid4().int >> 65  # a task that runs again writes blocks of its own; the table below says which count
                head = part.select(list(range(len(columns))))
                with pa.ipc.new_stream(sink := pa.BufferOutputStream(), head.schema) as out:
                    out.write_batch(head)
                ids = part.column(len(columns)).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64)
                put_arrays(f"{folder}/{block}", raw=raw, offsets=offsets, head=np.frombuffer(sink.getvalue(), np.uint8))
                place, hashes, first, last = block_anchors(raw, offsets, length, gram)
                owner = np.searchsorted(offsets, place, "right") - 1
                put_arrays(f"{folder}/{block}.anchors", key=hashes, owner=owner.astype(np.uint32), ids=ids,
                           p=place.astype(np.int64 if len(raw) >> 31 else np.int32), a=(place - first).astype(np.int16),
                           w=(last - first + 1).astype(np.int16))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(place)], pa.int64())], names=["block", "n"])

    blocks = stored(rows.mapInArrow(cut_blocks, "block long, n long"), "suffix-blocks")
    n_blocks, n_anchors = (int(x or 0) for x in blocks.agg(F.count("*"), F.sum("n")).first())
    shards = max(1, -(-n_anchors // SHARD_KEYS))
    answers: list[DataFrame] = []

    def anchors_asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in by_block(batches):
            keys, count = np.unique(Block(f"{folder}/{block}", length, gram).anchors.key, return_counts=True)
            yield cells(block, keys, [count.astype(np.uint32)], shards)

    def often(keys: np.ndarray, at: np.ndarray, _, facts: list[np.ndarray]) -> tuple[np.ndarray, int]:
        count = np.bincount(at, facts[0], len(keys))
        return (count[at] > 1).astype(np.uint8), int((count > 1).sum())

    def cores_asked(k: int):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, said in by_block(batches):
                now, order, start, facts, _ = Block(f"{folder}/{block}", length, gram).known(said, k).rounds[-1]
                if len(start):
                    yield cells(block, now.key[order][start], facts, shards)
        return ask

    def cores(keys: np.ndarray, at: np.ndarray, block: np.ndarray, facts: list[np.ndarray]) -> tuple[np.ndarray, int]:
        size, kinds, least, most, d, begin = facts
        n = len(keys)
        count, several = np.bincount(at, size, n), np.bincount(at, kinds, n)
        order = np.lexsort((begin, block, d, at))
        head = order[np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))]
        low, high = np.full(n, np.iinfo(np.uint64).max, np.uint64), np.zeros(n, np.uint64)
        np.minimum.at(low, at, least)
        np.maximum.at(high, at, most)
        differ = low != high
        many = differ & (several > meet)
        out = ((count > 1) * REPEATED + differ * DIFFER + many * MANY)[at].astype(np.uint8)
        out[head] |= FIRST
        return out, int(many.sum())

    k = 1
    while True:
        asked = whole_blocks(blocks, answers, n_blocks)
        if k == 1:
            found = answered(asked.mapInArrow(anchors_asked, cell_schema(1)), [np.uint32], shards, 1, often)
        else:
            found = answered(asked.mapInArrow(cores_asked(k), cell_schema(len(FACTS))), FACTS, shards, k, cores)
        found = stored(found, "suffix-answers")
        answers.append(found.where("block is not null").drop("total"))
        if k > 1 and not found.agg(F.sum("total")).first()[0]:
            break
        k += 1
    rounds = k

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts of cores whose contexts differ, one row for each that a block has, with its bytes."""
        for block, said in by_block(batches):
            own = Block(f"{folder}/{block}", length, gram).known(said, rounds)
            for turn, (now, order, _, _, told) in enumerate(own.rounds, 2):
                at = order[(told & (DIFFER | MANY)) == DIFFER]
                if not len(at):
                    continue
                key, ctx = now.key[at], now.ctx[at]
                _, first, copies = np.unique(np.stack([key, ctx], 1), axis=0, return_index=True, return_counts=True)
                data = own.raw.tobytes()
                for k in range(0, len(first), 4096):
                    rows = at[first[k : k + 4096]]
                    begin, count = now.begin[rows], now.count[rows]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(now.key[rows].view(np.int64)), pa.array(own.ids[now.doc[rows]]), pa.array(np.full(len(rows), block)),
                        pa.array(begin), pa.array(np.full(len(rows), turn, np.int32)),
                        pa.array(now.ctx[rows].view(np.int64)), pa.array(copies[k : k + 4096]), pa.array(count),
                        pa.array([data[i : i + w - 1 + length] for i, w in zip(begin.tolist(), count.tolist(), strict=True)], pa.binary())],
                        names=["key", "d", "block", "p", "turn", "ctx", "copies", "w", "raw"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.concat_batches(held)
            # The contexts of a core come in the order of their first occurrence, and only those can have windows in common.
            name = list(zip(rows.column(0).to_pylist(), rows.column(5).to_pylist(), strict=True))
            copies, raws, windows = rows.column(6).to_pylist(), rows.column(8).to_pylist(), rows.column(7).to_pylist()
            number: dict[tuple, int] = {}
            of = [number.setdefault(x, len(number)) for x in name]
            first = np.unique(of, return_index=True)[1].tolist()
            times = np.bincount(of, copies)
            dup, later = repeated([raws[k] for k in first], [windows[k] for k in first], length)
            heads, out = set(first), []
            for k, x in enumerate(of):
                if keep == "first":
                    flags = later[x] if k in heads else None
                else:
                    flags = dup[x] if times[x] == 1 else None
                bits = b"" if flags is None else np.packbits(flags).tobytes() if flags.any() else None
                out.append(None if bits is None else struct.pack("<qq", *name[k]) + bits)
            turns = pa.array(rows.column(4).to_numpy() + _FLAGS, pa.int32())
            result = pa.RecordBatch.from_arrays([rows.column(2), turns, pa.array([0] * rows.num_rows, pa.int64()),
                pa.array(out, pa.binary())], names=["block", "order", "shard", "cell"])
            return result.filter(pa.array([x is not None for x in out]))

        held, size = [], 0
        for b in _runs(batches, 0):
            key, at = b.column(0).to_numpy(), np.concatenate([[0], np.cumsum(pc.binary_length(b.column(8)).to_numpy())])
            edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for i, j in zip(edge, edge[1:], strict=False):  # a core at a time
                held.append(b.slice(i, j - i))
                size += int(at[j] - at[i])
                if size >= ARRAY_BYTES:
                    yield done(held)
                    held, size = [], 0
        if held:
            yield done(held)
        tb.release()

    met = whole_blocks(blocks, answers, n_blocks).mapInArrow(meeting,
        "key long, d long, block long, p long, turn int, ctx long, copies long, w long, raw binary")
    flags = met.repartition("key").sortWithinPartitions("key", "d", "block", "p").mapInArrow(search, TO_BLOCK)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, said in by_block(batches):
            own = Block(f"{folder}/{block}", length, gram).known(said, rounds)
            raw, offsets = own.raw, own.texts["offsets"]
            head = pa.ipc.open_stream(own.texts["head"].tobytes()).read_all().combine_chunks().to_batches()
            edge = np.zeros(len(raw) + 1, np.int64)
            for turn, (now, order, start, _, told) in enumerate(own.rounds, 2):
                whole = (told & (REPEATED | DIFFER)) == REPEATED  # plain copies
                if keep == "first":
                    heads = start[told[start] & FIRST > 0]
                    whole[heads] = False
                at = order[whole]
                flagged = {struct.unpack("<qq", c[:16]): c[16:] for c in said.get(_FLAGS + turn, [])}
                if flagged or keep == "first":
                    some = order[(told & (DIFFER | MANY)) == DIFFER]
                    seen: set[tuple] = set()
                    more = []
                    for x, name in zip(some.tolist(), zip(now.key[some].view(np.int64).tolist(),
                            now.ctx[some].view(np.int64).tolist(), strict=True), strict=True):
                        again = keep == "first" and name in seen  # copies within the block
                        seen.add(name)
                        bits = b"" if again else flagged.get(name)
                        if bits == b"":
                            more.append(x)
                        elif bits is not None:
                            spot = now.begin[x] + np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: now.count[x]])
                            np.add.at(edge, spot, 1)
                            np.add.at(edge, spot + length, -1)
                    at = np.concatenate([at, np.array(more, np.int64)])
                np.add.at(edge, now.begin[at], 1)
                np.add.at(edge, now.begin[at] + now.count[at] - 1 + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            starts, _, first = tb.runs(gone, offsets)
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[offsets[1:]] - total[offsets[:-1]]
            data = raw.tobytes()
            stay = raw[~gone].tobytes()
            left = offsets - total[offsets]
            parts = [stay[i:j] if g else data[p:q] for i, j, p, q,
                g in zip(left.tolist(), left[1:].tolist(), offsets.tolist(), offsets[1:].tolist(), removed.tolist(), strict=False)]
            out = [pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(first), pa.int64()),
                pa.array([hashlib.sha256(v).hexdigest() for v in parts], pa.string())]
            if cleaned:
                out.append(pa.array([v.decode("utf-8", "ignore") for v in parts], pa.string()))
            for h in head:
                yield pa.RecordBatch.from_arrays([*h.columns, *out],
                    names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", *["cleaned"] * cleaned])

    return whole_blocks(blocks, [*answers, flags], n_blocks).mapInArrow(
        finish, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", cleaned string" * cleaned)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="none", cleaned=False)
