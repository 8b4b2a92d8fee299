"""Vectorised helpers over Arrow string buffers: words, positions and position-independent hashes.

Everything works on the UTF-8 bytes of a slice of documents; a null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about so many bytes (one longer text makes a slice of its own).
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling and kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64) if have is None else have
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xA24BAED4963EE407)
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, (offsets - offsets[0]) if len(offsets) else np.zeros(1, np.int64)


def release() -> None:
    """Gives memory that is free back to the system: workers live on between tasks, and share an executor's limit."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = buffers(column)
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    release()


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return raw + ((raw - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that don't cross documents: starts, ends and, for each document, the first run (n+1)."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(inside), bool)
    before[1:] = inside[:-1]
    begin = inside & (~before | edge[:-1])
    starts = np.flatnonzero(begin)
    after = np.zeros(len(inside), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(raw)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that don't depend on where the span stands."""
    inverse = _power_table(_INVERSE, len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """The hash of the ``gram`` bytes from each place on."""
    sums = prefix_sums(raw)
    n = len(raw) - gram + 1
    return mix((sums[gram:] - sums[:n]) * _power_table(_INVERSE, n))
