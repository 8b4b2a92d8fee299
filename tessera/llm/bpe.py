"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the text's bytes cuts it into chunks, so that passages that documents share give equal chunks wherever
they stand. Equal chunks are encoded once and their ids kept (in each worker, within a bound of bytes; what is dropped is
encoded again). A cut may fall anywhere, so the ids on both sides of it can be wrong: the join is repaired by encoding the text
between the safe places around the cut anew, and going on to the next safe place until the new ids end on a token border of
both neighbours. A place is safe before a single space between two characters that aren't white space: no pre-token of the
vocabulary's pattern runs across it, so encoding left and right of it is encoding the whole.

The result is exact whatever the table of chunks holds. No shuffle; memory is bounded by an Arrow batch and the table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb

#: Bytes that the rolling hash sees; a chunk has 2**CHUNK_BITS bytes on average.
WINDOW, CHUNK_BITS = 16, 11
#: Most bytes of chunks and their ids that a worker keeps.
CHUNK_CACHE_BYTES = 32 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary file (tokenizers' JSON), with its table of chunks."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = {bytes(letters[c] for c in k): i for k, i in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for x in special:
            vocab.pop(x.encode(), None)
        self.encoding = tiktoken.Encoding(
            "vocabulary", special_tokens=special, mergeable_ranks=vocab,
            # Fixed value: the byte-level pre-tokenizer's pattern.
            pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for k, i in vocab.items():
            self.bytes_of[i] = k
        for k, i in special.items():
            self.bytes_of[i] = k.encode()
        self.lengths = np.array([len(x) for x in self.bytes_of], np.int64)
        self.decimal = [str(i) for i in range(len(self.bytes_of))]
        self.special = list(special)
        self.chunks: dict[bytes, list[int]] = {}
        self.kept = 0
        self.reused = self.encoded = 0

    def encode_plain(self, text: str) -> list[int]:
        """Without chunks."""
        if any(x in text for x in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)

    def _chunk(self, raw: bytes) -> list[int]:
        ids = self.chunks.get(raw)
        if ids is None:
            ids = self.encode_plain(raw.decode())
            self.encoded += 1
            if self.kept > CHUNK_CACHE_BYTES:
                self.chunks.clear()
                self.kept = 0
            self.chunks[raw] = ids
            self.kept += len(raw) + 8 * len(ids)
        else:
            self.reused += 1
        return ids

    def encode(self, raw: bytes, cuts: np.ndarray, safe: np.ndarray) -> list[int]:
        """The ids of a text, cut at ``cuts`` (character borders inside it); ``safe``: its safe places."""
        if not len(cuts):
            return self._chunk(raw)
        n = len(raw)
        edges = [0, *cuts.tolist(), n]
        chunks = [self._chunk(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        borders = [np.concatenate([[0], np.cumsum(self.lengths[x])]) for x in chunks]
        # The text to encode anew around each cut, widened until both its ends are token borders of the chunks there.
        places = np.concatenate([[0], safe, [n]])
        spans: list[list[int]] = []
        for cut in cuts.tolist():
            lo, hi = int(np.searchsorted(places, cut, "right")) - 1, int(np.searchsorted(places, cut, "left"))
            while lo > 0 and not self._border(edges, borders, int(places[lo]), False):
                lo -= 1
            while hi < len(places) - 1 and not self._border(edges, borders, int(places[hi]), True):
                hi += 1
            p, q = int(places[lo]), int(places[hi])
            if p == q:
                continue
            if spans and p <= spans[-1][1]:
                spans[-1][1] = max(q, spans[-1][1])
            else:
                spans.append([p, q])
        out: list[int] = []
        at = 0
        for p, q in [*spans, [n, n]]:
            # Whole chunks, or their parts, from ``at`` to ``p``.
            k = max(0, int(np.searchsorted(cuts, at, "right")))
            while at < p:
                stop = min(p, edges[k + 1])
                i, j = np.searchsorted(borders[k], [at - edges[k], stop - edges[k]])
                out += chunks[k][i:j]
                at, k = stop, k + 1
            if q > p:
                out += self.encode_plain(raw[p:q].decode())
            at = q
        return out

    def _border(self, edges: list[int], borders: list[np.ndarray], place: int, right: bool) -> bool:
        """Whether ``place`` is a token border of the chunk that it stands in."""
        k = int(np.searchsorted(edges, place, "right" if right else "left")) - 1
        k = min(max(k, 0), len(borders) - 1)
        i = int(np.searchsorted(borders[k], place - edges[k]))
        return i < len(borders[k]) and int(borders[k][i]) == place - edges[k]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary: loaded once."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def cut_places(raw: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Where the rolling hash cuts: character borders strictly inside documents."""
    if len(raw) <= WINDOW:
        return np.zeros(0, np.int64)
    cuts = WINDOW + np.flatnonzero((tb.gram_hashes(raw, WINDOW)[:-1] & np.uint64((1 << bits) - 1)) == 0)
    while len(move := np.flatnonzero((cuts < len(raw)) & ((raw[np.minimum(cuts, len(raw) - 1)] & 0xC0) == 0x80))):
        cuts[move] += 1
    cuts = np.unique(cuts)
    at = np.searchsorted(offsets, cuts, "left")
    return cuts[(cuts < len(raw)) & (offsets[np.minimum(at, len(offsets) - 1)] != cuts)]


def safe_places(raw: np.ndarray) -> np.ndarray:
    """Before a space between two ASCII characters that aren't white space."""
    solid = (raw - np.uint8(33)) < 94
    found = np.zeros(len(raw), bool)
    found[1:-1] = (raw[1:-1] == 32) & solid[:-2] & solid[2:]
    return np.flatnonzero(found)


def encoded_batch(coder: Codec, batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, list[list[int]]]]:
    """Slices of the batch with their texts' ids."""
    for part in tb.slices(batch, text):
        raw, offsets = tb.buffers(part.column(part.schema.get_field_index(text)))
        cuts, safe = cut_places(raw, offsets), safe_places(raw)
        c, s = np.searchsorted(cuts, offsets), np.searchsorted(safe, offsets)
        data = raw.tobytes()
        starts = offsets.tolist()
        yield part, [
            coder.encode(data[a:b], cuts[c[k] : c[k + 1]] - a, safe[s[k] : s[k + 1]] - a)
            for k, (a, b) in enumerate(zip(starts, starts[1:], strict=False))]



def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Each text's ids: id, ids (array of int). ``vocabulary`` is a path that every executor can read.

    Defined cases: a null or empty text has no ids; the special tokens' strings in a text become their ids; null and
    repeated ids are kept, row by row; an empty table gives no rows; other columns are left out.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for b in batches:
            for part, ids in encoded_batch(coder, b, text_col):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The texts of ids: id, text; special tokens become their strings; null ids give an empty text."""
    path = vocabulary or default_vocabulary()
    kind = encoded.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for b in batches:
            texts = [coder.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(work, f"`{id_col}` {kind}, text string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Encodes and decodes every text in one pass and keeps the digests: id, n_tokens, ids_sha256, decoded_sha256."""
    path = vocabulary or default_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        decimal = coder.decimal.__getitem__
        for b in batches:
            for part, ids in encoded_batch(coder, b, text_col):
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal, x)).encode()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(work, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenise(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep``, n_tokens, ids (array of int) and exact: whether the ids decode to the very text."""
    path = vocabulary or default_vocabulary()
    rows = docs.select(*keep, F.col(text_col).alias("_t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for b in batches:
            for part, ids in encoded_batch(coder, b, "_t"):
                texts = part.column(len(keep)).to_pylist()
                yield pa.RecordBatch.from_arrays([
                    *part.columns[: len(keep)], pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                    pa.array([coder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_())],
                    names=[*keep, "n_tokens", "ids", "exact"])

    return rows.mapInArrow(work, schema + ", n_tokens long, ids array<int>, exact boolean")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
