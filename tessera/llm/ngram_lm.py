"""Language-model scoring by a weighted backoff automaton over the n-grams of the whole corpus.

All words, pairs and triples of the training texts are counted, whatever their number. They are smoothed towards the shorter
context (a Dirichlet prior of weight ``PRIOR``) and become an automaton: a state for each context that was seen (none, a word, a pair,
the start of a text), an arc for each n-gram that was seen, and from each state with a context a failure arc to the state with the
shorter one, whose weight is what the seen n-grams leave. A text is read once from left to right: in each state the arc of the
next word is taken, after as many failure arcs as it needs, and the weights are summed.

Scale: texts are never shuffled. They are written once, in blocks, to the shared folder (as places in the block's list of distinct
words). Blocks send their distinct n-grams' 64-bit hashes and counts to the shard of the hash, in cells of one block and shard; the sums come
back in the same order. N-grams go order by order: a pair of which a word occurs once in the corpus, or a triple of which a pair does,
occurs once as well, so that its block knows its count and doesn't send it. A frequent n-gram is one entry a block, never one a document.
Each block then builds the part of the automaton that its own texts can reach, so nothing is broadcast or sent to the driver but sums.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .exchange import answered, by_block, cell_schema, cells, packed, unpacked, whole_blocks
from .shared import get_arrays, make_folder, put_arrays, stored

#: Text bytes in a block; the base's smoothing; the prior's weight for a context of one word, and of two.
BLOCK_BYTES, SMOOTH, PRIOR = 8 << 20, 0.1, (20.0, 4.0)
#: N-grams that meet in a shard, as an upper bound of the mean; tokens of a text that are read in one go.
SHARD_KEYS, SEGMENT = 1_000_000, 512
#: Hashes of the end token and of the start of a text: no word's, as far as 64 bits go.
END, START = np.uint64(0x5BD1E995C6A4A793), np.uint64(0x1F83D9ABFB41BD6B)
#: A shard's answer: occurrences in training texts, and in the others.
COUNTS = np.dtype([("train", np.int64), ("other", np.int64)])


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens, each text's words and then its end; and the first token of each text (n+1)."""
    low = tb.lower_ascii(raw)
    starts, ends, first = tb.runs(~((low == 32) | ((low >= 9) & (low <= 13))), offsets)
    hashes = tb.span_hashes(tb.prefix_sums(low), starts, ends)
    n = len(offsets) - 1
    at = first + np.arange(n + 1)
    out = np.full(len(starts) + n, END, np.uint64)
    words = np.ones(len(out), bool)
    words[at[1:] - 1] = False
    out[words] = hashes
    return out, at


class Block:
    """A block's texts as places in its distinct words, and its n-grams of each order with their counts, as far as they are known.

    ``own`` are the counts within the block, ``train`` and ``every`` those over the corpus (training texts; all texts)."""

    def __init__(self, path: str) -> None:
        x = get_arrays(path)
        self.words, self.at, self.first, self.learn, self.ids = x["words"], unpacked(x["at"].tobytes(), np.uint32).astype(np.int64), x["first"], x["learn"], x["ids"]
        self.n = len(self.words)
        self.token_learns = np.repeat(self.learn, np.diff(self.first))
        self.places: dict[int, np.ndarray] = {1: self.at}
        self.codes: dict[int, np.ndarray] = {}
        self.keys = {1: self.words}
        self.train: dict[int, np.ndarray] = {}
        self.every: dict[int, np.ndarray] = {}
        self.asked = {1: np.ones(self.n, bool)}

    def own(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        place, n = self.places[order], len(self.keys[order])
        there = place >= 0
        learns = self.token_learns[there]
        place = place[there]
        return np.bincount(place[learns], minlength=n), np.bincount(place, minlength=n)

    def grow(self, order: int) -> None:
        """N-grams of the next order, from those of the one before, whose counts are known; and which of them others may have too."""
        if order == 2:
            before = np.empty_like(self.at)
            before[1:] = self.at[:-1]
            before[self.first[:-1]] = self.n  # the start
            self.codes[2], self.places[2] = np.unique(before * self.n + self.at, return_inverse=True)
            u, v = self.codes[2] // self.n, self.codes[2] % self.n
            words = np.append(self.words, START)
            self.keys[2] = tb.mix(tb.mix(words[u]) * np.uint64(0x9E3779B97F4A7C15) + self.words[v])
            every = np.append(self.every[1], 2)
            self.asked[2] = (every[u] > 1) & (every[v] > 1)
            return
        pairs = self.places[2]
        later = np.ones(len(self.at), bool)
        later[self.first[:-1]] = False
        spot = np.flatnonzero(later)
        self.codes[3], place = np.unique(pairs[spot - 1] * self.n + self.at[spot], return_inverse=True)
        self.places[3] = np.full(len(self.at), -1)
        self.places[3][spot] = place
        head, v = self.codes[3] // self.n, self.codes[3] % self.n
        self.tail = np.empty(len(self.codes[3]), np.int64)  # the pair that ends the triple
        self.tail[place] = pairs[spot]
        self.keys[3] = tb.mix(self.keys[2][head] * np.uint64(0xD6E8FEB86659FD93) + self.words[v] + np.uint64(1))
        self.asked[3] = (self.every[2][head] > 1) & (self.every[2][self.tail] > 1)

    def question(self, order: int) -> np.ndarray:
        """The n-grams to ask for, in the order of their hash."""
        asked = np.flatnonzero(self.asked[order])
        return asked[np.argsort(self.keys[order][asked], kind="stable")]

    def learned(self, order: int, cells: list[bytes]) -> None:
        """Counts over the corpus from the shards' answers, in the order of shards; the others' are the block's own."""
        self.train[order], self.every[order] = self.own(order)
        if cells:
            at = self.question(order)
            counts = np.concatenate([unpacked(c, COUNTS) for c in cells])
            self.train[order][at], self.every[order][at] = counts["train"], counts["train"] + counts["other"]


class Automaton:
    """State 0 has no context; 1 + w is the context of a word (w = words: the start of a text), the others are pairs. ``arcs`` are sorted
    state * words + word, with weights and targets; each state but 0 has a failure arc; state 0 has an arc for each word."""

    def __init__(self, words: int, root: np.ndarray, home: np.ndarray, arcs: np.ndarray, weights: np.ndarray, targets: np.ndarray,
            failure: np.ndarray, leave: np.ndarray) -> None:
        self.words, self.root, self.home, self.arcs, self.weights, self.targets, self.failure, self.leave = words, root, home, arcs, weights, targets, failure, leave

    @classmethod
    def of_counts(cls, codes: dict[int, np.ndarray], tail: np.ndarray, count: dict[int, np.ndarray], tokens: int, texts: int, distinct: int,
            prior: tuple[float, float] = PRIOR) -> Automaton:
        """From n-grams and their training counts: pairs are u * words + v, triples pair * words + w; ``tail`` is a triple's last pair."""
        n = len(count[1])
        one = (count[1] + SMOOTH) / (tokens + SMOOTH * (distinct + 1))
        context = np.append(count[1], texts)
        u, v = codes[2] // n, codes[2] % n
        two = (count[2] + prior[0] * one[v]) / (context[u] + prior[0])
        head, w = codes[3] // n, codes[3] % n
        three = (count[3] + prior[1] * two[tail]) / (count[2][head] + prior[1])
        pairs, triples = np.flatnonzero(count[2] > 0), np.flatnonzero(count[3] > 0)
        first_pair = n + 2
        home = np.where(count[1] > 0, 1 + np.arange(n), 0)
        arcs = np.concatenate([(1 + u[pairs]) * n + v[pairs], (first_pair + head[triples]) * n + w[triples]])
        weights = np.log10(np.concatenate([two[pairs], three[triples]]))
        targets = np.concatenate([first_pair + pairs, first_pair + tail[triples]])
        failure = np.concatenate([np.zeros(n + 2, np.int64), home[v]])
        leave = np.log10(np.concatenate([[1.0], prior[0] / (context + prior[0]), prior[1] / (count[2] + prior[1])]))
        return cls(n, np.log10(one), home, arcs, weights, targets, failure, leave)  # codes are sorted, so arcs are

    def move(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads a word in each state: the new states, and the weights of the arcs that were taken."""
        state, weight, new = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            s, w = state[left], word[left]
            at_root = s == 0
            done = left[at_root]
            weight[done] += self.root[word[done]]
            new[done] = self.home[word[done]]
            left, s, w = left[~at_root], s[~at_root], w[~at_root]
            if not len(left):
                break
            key = s * self.words + w
            at = np.minimum(np.searchsorted(self.arcs, key), max(len(self.arcs) - 1, 0))
            hit = self.arcs[at] == key if len(self.arcs) else np.zeros(len(key), bool)
            weight[left[hit]] += self.weights[at[hit]]
            new[left[hit]] = self.targets[at[hit]]
            left, s = left[~hit], s[~hit]
            weight[left] += self.leave[s]
            state[left] = self.failure[s]
        return new, weight

    def read(self, tokens: np.ndarray, first: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """The weight of each token of texts that begin at ``first``. Long texts are read from several places at a time: a state is what its
        last two words lead to, so reading these two first gives the state in which a place is reached."""
        out = np.zeros(len(tokens))
        size = np.diff(first)
        parts = -(-size // segment)
        text = np.repeat(np.arange(len(size)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + number * segment
        stop = np.minimum(begin + segment, first[text + 1])
        state = np.where(begin - 2 < first[text], 1 + self.words, 0)
        for back in (2, 1):
            inner = np.flatnonzero(begin - back >= first[text])
            state[inner], _ = self.move(state[inner], tokens[begin[inner] - back])
        order = np.argsort(begin - stop, kind="stable")  # the longest first
        begin, stop, state = begin[order], stop[order], state[order]
        length = stop - begin
        for k in range(int(length.max()) if len(length) else 0):
            live = int(np.searchsorted(-length, -k, "left"))
            state[:live], out[begin[:live] + k] = self.move(state[:live], tokens[begin[:live] + k])
        return out


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
        shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Scores all texts, learning from those whose crc32(id as text) modulo 10 is not 0.

    Returns id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with additive smoothing) and score (log10).

    Defined cases: a null or empty text is the end token alone; a null id counts as the empty string; repeated rows count
    and are scored each; a text longer than a block is a block of its own, read from several places at a time with the same result; words
    never seen share one probability; without training documents, score and base come from the smoothing alone; an empty table
    gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    folder = make_folder(spark, "lm")
    held = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    rows = docs.select(F.col(id_col).alias("i"), held.alias("h"), F.col(text_col).alias("t"))

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.slices(b, "t", block_bytes):
                pieces, firsts = [], [np.zeros(1, np.int64)]
                for piece in tb.slices(part.select([2]), "t"):  # a little text at a time
                    hashes, first = tokens_of(*tb.buffers(piece.column(0)))
                    pieces.append(hashes)
                    firsts.append(first[1:] + firsts[-1][-1])
                first = np.concatenate(firsts)
                words, at = np.unique(np.concatenate(pieces), return_inverse=True)
                learn = ~np.array(part.column(1).to_pylist(), bool)
                block = uuid.uuid4().int >> 65  # a task that runs again writes blocks of its own; the table below says which count
                schema = pa.schema([part.schema.field(0)])
                with pa.ipc.new_stream(sink := pa.BufferOutputStream(), schema) as out:
                    out.write_batch(pa.RecordBatch.from_arrays([part.column(0)], schema=schema))
                put_arrays(f"{folder}/{block}", words=words, at=np.frombuffer(packed(at.astype(np.uint32)), np.uint8), first=first,
                    learn=learn, ids=np.frombuffer(sink.getvalue(), np.uint8))
                tokens = int(np.diff(first)[learn].sum())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (block, tokens,
                    int(learn.sum()), len(at), len(words))], names=["block", "tokens", "texts", "n", "words"])

    blocks = stored(rows.mapInArrow(tokenise, "block long, tokens long, texts long, n long, words long"), "lm-blocks")
    n_train, n_texts, n_tokens, n_words, n_blocks = (int(x or 0) for x in blocks.agg(*[F.sum(c) for c in ("tokens", "texts", "n", "words")], F.count("*")).first())

    def known(block: int, answers: dict[int, list[bytes]], orders: int) -> Block:
        own = Block(f"{folder}/{block}")
        for order in range(1, orders + 1):
            if order > 1:
                own.grow(order)
            own.learned(order, answers.get(order, []))
        return own

    def dealt(order: int, shards: int):
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, answers in by_block(batches):
                own = known(block, answers, order - 1)
                if order > 1:
                    own.grow(order)
                at = own.question(order)
                train, every = (x[at] for x in own.own(order))
                yield cells(block, own.keys[order][at], [train.astype(np.uint32), (every - train).astype(np.uint32)], shards)
        return deal

    def sums(keys: np.ndarray, at: np.ndarray, _, facts: list[np.ndarray]) -> tuple[np.ndarray, int]:
        """Counts over the corpus, of training texts and of others; and how many n-grams were learned."""
        train, other = (np.bincount(at, x, len(keys)).astype(np.int64) for x in facts)
        out = np.empty(len(at), COUNTS)
        out["train"], out["other"] = train[at], other[at]
        return out, int((train > 0).sum())

    found, distinct = [], 0
    for order in (1, 2, 3):
        shards = max(1, -(-(n_words if order == 1 else n_tokens) // shard_keys))
        asked = whole_blocks(blocks, found, n_blocks).mapInArrow(dealt(order, shards), cell_schema(2))
        rows = stored(answered(asked, [np.uint32, np.uint32], shards, order, sums), "lm-counts")
        if order == 1:
            distinct = int(rows.agg(F.sum("total")).first()[0] or 0)
        found.append(rows.where("block is not null").drop("total"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, answers in by_block(batches):
            own = known(number, answers, 3)
            machine = Automaton.of_counts(own.codes, own.tail, own.train, n_train, n_texts, distinct)
            at, first = own.at, own.first
            add = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has a token
            ids = pa.ipc.open_stream(own.ids.tobytes()).read_all().column(0).combine_chunks()
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(~own.learn, pa.bool_()), pa.array(np.diff(first), pa.int64()),
                pa.array(add((own.train[1][at] > 0).astype(np.int64)), pa.int64()),
                pa.array(np.full(len(first) - 1, n_train), pa.int64()), pa.array(add(machine.root[at]), pa.float64()),
                pa.array(add(machine.read(at, first)), pa.float64())],
                names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return whole_blocks(blocks, found, n_blocks).mapInArrow(
        score, f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
