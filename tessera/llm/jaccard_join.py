"""N-gram Jaccard self-join of texts: an LSH forest of MinHash prefixes, then exact verification.

Texts with the same set of word shingles are one class, and one representative of it is compared. Its MinHash values are dealt
to ``TREES`` prefix tries, ``DEEPEST`` values each: a label of that many bytes in each tree, and the sorted labels of a tree are its trie.
All trees are sorted together (by range, so that no label is too frequent for a task). Matched prefixes are shortened value by value, from
whole labels on; ``shortest`` says where that ends: as soon as a pair at the threshold shares a prefix in some tree with
probability ``RECALL``. Below each node of that depth, members of a deeper node meet first; in a node, members join a pivot if
their signatures leave room for a link between them or anything that left with them, members near the pivot leave with it and widen its
radius, and only pivots go on when the prefix is shortened. A node whose members are of one group already is passed over. The joined
sets are candidate groups, in which all pairs are verified exactly on their shingles (as 64-bit hashes), in tiles of bounded size.

Scale: copies are summed up before any shuffle of more than digests. Nodes of over ``BUCKET`` members are split by a hash of the member, and
the pivots of the splits meet by blocks, two by two; groups over ``TILE`` members or ``TILE_BYTES`` are dealt in pairs of blocks. A tile
emits a count for each member and the edges of a spanning forest, never its pairs. No links, labels or signatures reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .decontaminate import words_of
from .shared import components, stored

#: Words in a shingle; the similarity from which texts are linked.
SHINGLE, THRESHOLD = 5, 0.8
#: The forest: trees, MinHash values in a label (a byte of each), the target recall.
TREES, DEEPEST, RECALL = 24, 8, 0.9999
#: Most members of a node in one task; most members, and shingle bytes in the mean, of each of the two blocks of a tile.
BUCKET, TILE, TILE_BYTES = 1024, 1024, 4 << 20
#: Trees whose nodes are joined first.
FIRST_TREES = 4
#: Signatures guess a similarity; a guess is off by more than so many standard deviations for about one in a million.
DEVIATIONS = 4.75
#: Members that seem to be at least so like a pivot leave with it, while nothing that left is further than this from it.
APART, MOST_RADIUS = 0.9, 0.3
#: Representatives that are looked up by a broadcast; more of them are joined by sorting.
BROADCAST_ROWS = 200_000


def shortest(trees: int = TREES, threshold: float = THRESHOLD, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """Prefixes are shortened from ``deepest`` on until pairs at the threshold meet with the target recall."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def slack(similarity: np.ndarray) -> np.ndarray:
    """How far off a signature's guess of a similarity may be."""
    return DEVIATIONS * np.sqrt(similarity * (1 - similarity) / (TREES * DEEPEST))


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = np.arange(1, 2 * n + 1, dtype=np.uint64)
    x = tb.mix(seed * np.uint64(0x9E3779B97F4A7C15))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingles; a text of fewer words has one shingle of them all, one without words none."""
    _, _, words, first = words_of(raw, offsets)
    odd = [np.uint64(int(2 * k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)) for k in range(size)]
    if len(words) >= size:
        n = len(words) - size + 1
        every = words[:n] * odd[0]
        for k in range(1, size):
            every = tb.mix(every) + words[k : k + n] * odd[k]
        every = tb.mix(every)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values, one for each constant."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(h), 512):
        np.minimum(low, (h[k : k + 512, None] * a + b).min(0), out=low)
    return low


def summarise(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each document's set digest, number of shingles, labels in the trees, and a hash of its text: the only pass over all texts."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(TREES * DEEPEST)
        for batch in batches:
            for part in tb.slices(batch, "t"):
                raw, offsets = tb.buffers(part.column(1))
                digests, sizes, labels = [], [], []
                for k, s in enumerate(shingle_sets(raw, offsets)):
                    sizes.append(len(s))
                    if not len(s):
                        digests.append(xxhash.xxh3_128_digest(raw[offsets[k] : offsets[k + 1]].tobytes(), seed=1))
                        labels.append(None)
                        continue
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                    labels.append(signature(s, a, b).astype(np.uint8).view(">i8").astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()),
                    pa.array(labels, pa.list_(pa.int64())), part.column(2)], names=["id", "digest", "n", "labels", "h"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    return stored(rows.mapInArrow(work, f"id {kind}, digest binary, n long, labels array<long>, h long"), "jaccard-docs")


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """Runs of rows with equal first columns, as columns."""
    key, columns = None, []
    for b in batches:
        lists = [c.to_pylist() for c in b.columns]
        for row in zip(*lists, strict=True):
            if row[:n_keys] != key:
                if columns:
                    yield key, list(zip(*columns, strict=True))
                key, columns = row[:n_keys], []
            columns.append(row[n_keys:])
    if columns:
        yield key, list(zip(*columns, strict=True))


def _prefix(label: np.ndarray, values: int) -> np.ndarray:
    """The first values of labels, as numbers."""
    return label >> (8 * (DEEPEST - values))


def trie_nodes(reps: DataFrame, depth: int) -> DataFrame:
    """Members (tree, label, digest) of all trees that share a prefix of ``depth`` values with another one (or stand at the border of a range).

    The trees are sorted by range of tree, label and member, so that also a label of a third of all members is dealt over tasks."""
    rows = reps.where("n > 0").select("digest", F.posexplode("labels").alias("tree", "label"))
    dealt = rows.repartitionByRange("tree", "label", "digest").sortWithinPartitions("tree", "label").select("tree", "label", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last member, and whether its prefix was met before it
        for b in batches:
            if not b.num_rows:
                continue
            if held is not None:
                b = pa.concat_batches([held, b])
            tree, prefix = b.column(0).to_numpy(), _prefix(b.column(1).to_numpy(), depth)
            same = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1])
            met = np.concatenate([[True if before is None else before], same]) | np.concatenate([same, [False]])
            yield b.slice(0, b.num_rows - 1).filter(pa.array(met[:-1]))
            held, before = b.slice(b.num_rows - 1), bool(same[-1]) if len(same) else True if before is None else before
        if held is not None:
            yield held

    return dealt.mapInArrow(work, "tree int, label long, digest binary")


def _meet(own: np.ndarray, group: np.ndarray, radius: np.ndarray, left: np.ndarray, threshold: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Edges that join two groups, and the pivots of the members ``left``. By the triangle inequality of the distance 1 - s, members whose
    distance is over that of a link and both radii have no link, nor has anything that left with them."""
    edges, pivots = [], []
    while len(left):
        pivot, left = int(left[0]), left[1:]
        pivots.append(pivot)
        if not len(left):
            break
        like = (own[left] == own[pivot]).mean(1)
        far = 1 - like + slack(np.minimum(like, 0.97)) + radius[left]
        leave = (like >= APART) & (far <= MOST_RADIUS)
        radius[pivot] = max(radius[pivot], far[leave].max(initial=0.0))
        least = np.maximum(threshold - radius[pivot] - radius[left], 0.0)
        joined = left[like >= least - slack(least)]
        groups, first = np.unique(group[joined], return_index=True)
        for g, k in zip(groups.tolist(), joined[first].tolist(), strict=True):
            if g != group[pivot]:
                edges.append((k, pivot))
                group[group == g] = group[pivot]
        left = left[~leave]
    return edges, pivots


def walk(own: np.ndarray, label: np.ndarray, group: np.ndarray, radius: np.ndarray, depth: int, threshold: float,
        all_pivots: bool = False) -> tuple[list[tuple[int, int]], list[int]]:
    """Joins the members of a node of ``depth``, sorted by label, from the whole labels' nodes on: prefixes are shortened by a value at a time,
    and only pivots go on. ``group`` names the groups known so far; it and ``radius`` are changed. Returns edges that join two groups, and
    the pivots (with ``all_pivots`` also of nodes that have nothing to join)."""
    edges: list[tuple[int, int]] = []
    alive = np.arange(len(label))
    for values in range(DEEPEST, depth - 1, -1):
        prefix = _prefix(label[alive], values)
        begin = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        if len(begin) == len(alive):
            continue
        on = []
        for i, j in zip(begin.tolist(), np.append(begin[1:], len(alive)).tolist(), strict=True):
            node = alive[i:j]
            if j - i == 1 or not all_pivots and (group[node] == group[node[0]]).all():
                on.extend(node.tolist())
                continue
            found, stay = _meet(own, group, radius, node, threshold)
            edges += found
            on.extend(stay)
        alive = np.array(on, np.int64)
    return edges, alive.tolist()


def _pivot_round(members: DataFrame, depth: int, threshold: float) -> DataFrame:
    """In each (bucket, part): edges that join two of the groups ``comp`` known so far, and, for buckets that are split, the pivots (b null)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, _), (digests, labels, trees, comps, radii, split) in _groups(batches, 2):
            if not split[0] and len(set(comps)) == 1:
                continue
            table = np.array(labels, np.int64)
            label = table[np.arange(len(trees)), np.array(trees)]
            order = np.lexsort((np.array([int.from_bytes(d[:7], "big") for d in digests]), label))
            own, radius = table.view(np.uint8).reshape(len(table), -1)[order], np.array(radii)[order]
            _, group = np.unique(np.array(comps, dtype=object), return_inverse=True)
            edges, pivots = walk(own, label[order], group[order], radius, depth, threshold, split[0])
            out = [(bucket, digests[order[a]], digests[order[b]], None, None, None, None) for a, b in edges]
            if split[0]:
                out += [(bucket, digests[order[k]], None, labels[order[k]], trees[order[k]], comps[order[k]], radius[k]) for k in pivots]
            if out:
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32(), pa.binary(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    names=["bucket", "a", "b", "labels", "tree", "comp", "radius"])
        tb.release()

    dealt = members.repartition("bucket", "part").sortWithinPartitions("bucket", "part").select("bucket", "part", "digest", "labels",
        "tree", "comp", "radius", "split")
    return dealt.mapInArrow(work, "bucket long, a binary, b binary, labels array<long>, tree int, comp binary, radius double")


def _joined(members: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Edges (a, b) of all buckets; the pivots of split ones meet in blocks, two by two."""
    found = stored(_pivot_round(members, depth, threshold), "jaccard-pivots")
    edges = found.where("b is not null").select("a", "b")
    pivots = found.where("b is null")
    if pivots.isEmpty():
        return edges
    rows = pivots.select("bucket", F.col("a").alias("digest"), "labels", "tree", "comp", "radius")
    count = rows.groupBy("bucket").agg(F.ceil(2 * F.count("*") / BUCKET).cast("int").alias("n"))
    rows = rows.join(count, "bucket").withColumn("own", F.pmod(F.xxhash64("digest", F.lit(-1)), F.col("n")).cast("int"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.withColumn("part", F.least("own", "k") * F.col("n").cast("long") + F.greatest("own", "k")).withColumn("split", F.lit(False))
    return edges.union(stored(_pivot_round(rows, depth, threshold), "jaccard-pivots").select("a", "b"))


def candidate_groups(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Groups (digest, comp) such that pairs at the threshold that share a prefix are in one."""
    depth = shortest(threshold=threshold)
    prefix = F.shiftright(F.col("label"), 8 * (DEEPEST - depth))
    rows = stored(trie_nodes(reps, depth).withColumn("bucket", F.xxhash64("tree", prefix)), "jaccard-nodes")
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("m"), F.min("tree").alias("t"),
        F.sum(F.xxhash64("digest").cast("decimal(38,0)")).alias("who")).where("m > 1")
    # Nodes with the same members: one of them is enough.
    buckets = buckets.groupBy("m", "who").agg(F.min(F.struct("t", "bucket")).alias("b")).select("m", "b.bucket")
    members = rows.join(buckets.hint("merge"), "bucket").select("bucket", "tree", "digest", "m")
    members = stored(members.join(reps.select("digest", "labels").hint("merge"), "digest").select(
        "tree", "bucket", "digest", "labels", F.pmod(F.xxhash64("digest"), F.ceil(F.col("m") / BUCKET)).alias("part"),
        (F.col("m") > BUCKET).alias("split"), F.lit(0.0).alias("radius")), "jaccard-members")
    # The first trees join most of what there is; the others only add what joins two groups.
    first = members.where(F.col("tree") < FIRST_TREES).withColumn("comp", F.col("digest"))
    known = components(_joined(first, depth, threshold), "jaccard-first").toDF("digest", "comp")
    later = members.where(F.col("tree") >= FIRST_TREES).join(known, "digest", "left").withColumn("comp", F.coalesce("comp", "digest"))
    open_ones = later.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    more = _joined(later.join(open_ones.hint("merge"), "bucket", "left_semi"), depth, threshold)
    label = known.toDF("node", "label")
    more = more.join(label.toDF("a", "la"), "a", "left").join(label.toDF("b", "lb"), "b", "left").select(F.coalesce("la", "a").alias("a"),
        F.coalesce("lb", "b").alias("b"))
    merged = components(more, "jaccard-groups").toDF("comp", "final")
    # Nodes of the first groups, and those that only later edges reach.
    every = known.union(merged.select(F.col("comp").alias("digest"), F.col("comp")).join(known.select("digest"), "digest", "left_anti")).toDF("digest", "comp")
    return every.join(merged, "comp", "left").select("digest", F.coalesce("final", "comp").alias("comp"))


def overlaps(sets: list[np.ndarray], split: int | None) -> np.ndarray:
    """How many shingles each two of the sets share; with ``split``, only pairs across that place matter."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    often = np.diff(np.concatenate([start, [len(values)]]))
    shared = np.zeros((m, m), np.float32)
    for f in np.unique(often[often > 1]).tolist():
        if f > 24:
            break
        at = start[often == f]
        who = owner[at[:, None] + np.arange(f)]  # each row ascending
        for x in range(f):
            for y in range(x + 1, f):
                np.add.at(shared, (who[:, x], who[:, y]), 1)
    many = np.flatnonzero(often > 24)
    for k in range(0, len(many), 512):
        part = many[k : k + 512]
        dense = np.zeros((m, len(part)), np.float32)
        for j, (a, n) in enumerate(zip(start[part].tolist(), often[part].tolist(), strict=True)):
            dense[owner[a : a + n], j] = 1
        shared += np.triu(dense @ dense.T, 1)
    if split is not None:
        shared[:split, :split] = 0
        shared[split:, split:] = 0
    return shared


def verify(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Exact links within groups. Rows of (comp, m, size, digest, text) -> (a, b, links): b null with a's links, or an edge of a forest.

    ``m`` and ``size`` are the group's members and shingles: they say in how many blocks it is dealt."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("m") / TILE), F.ceil(F.col("size") * 8 / TILE_BYTES)).cast("int")
    own = F.pmod(F.xxhash64("digest", F.lit(7)), blocks).cast("int")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tb.slices(b, "text"):
                sets = shingle_sets(*tb.buffers(part.column(1)))
                # Rows that share the representative's id but not its text go.
                same = pa.array([xxhash.xxh3_128_digest(s.tobytes()) == d for s, d in zip(sets, part.column(3).to_pylist(), strict=True)], pa.bool_())
                out = [part.column(0), part.column(2), part.column(3), part.column(4), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["comp", "own", "digest", "n", "s"]).filter(same)

    sets = texts.withColumn("own", own).withColumn("n", blocks).select("comp", "text", "own", "digest", "n").mapInArrow(
        shingled, "comp binary, own int, digest binary, n int, s binary")
    dealt = sets.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "comp", F.least("own", "k").alias("i"), F.greatest("own", "k").alias("j"), "own", "digest", "s")
    dealt = dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j", "own", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), (owns, digests, raws) in _groups(batches, 3):
            once = {d: (o, s) for o, d, s in zip(owns, digests, raws, strict=True)}  # repeated rows are one text
            digests, owns, raws = list(once), [x[0] for x in once.values()], [x[1] for x in once.values()]
            if len(digests) == 1:
                continue
            sets = [np.frombuffer(x, np.uint64) for x in raws]
            linked = overlaps(sets, None if i == j else sum(x == i for x in owns))
            size = np.array([len(s) for s in sets], np.float32)
            for k in range(len(sets)):  # a row at a time: a link if shared >= threshold * (size + size - shared)
                row = linked[k]
                linked[k] = (row > 0) & (row * (1 + threshold) >= threshold * (size[k] + size) - 1e-4)
            linked = linked.astype(bool)
            links = linked.sum(0) + linked.sum(1)
            root = np.arange(len(sets))
            while True:  # the least member that links reach
                low = root.copy()
                for k in np.flatnonzero(linked.any(1)).tolist():
                    to = np.flatnonzero(linked[k])
                    least = min(low[k], low[to].min())
                    low[k] = least
                    low[to] = np.minimum(low[to], least)
                low = low[low]
                if (low == root).all():
                    break
                root = low
            out = [(digests[k], None, int(n)) for k, n in enumerate(links) if n]
            out += [(digests[k], digests[r], 0) for k, r in enumerate(root.tolist()) if r != k]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c,
                    t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["a", "b", "links"])
        tb.release()

    return stored(dealt.mapInArrow(work, "a binary, b binary, links long"), "jaccard-links")


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, hashed: bool = False) -> DataFrame:
    """Near-duplicate groups of documents whose word 5-gram sets have a Jaccard similarity of at least ``threshold``.

    Returns one row per row: id, class_id (the least id of its group: all that chains of links reach), text_id (the least id with
    the same shingles), n_copies (rows with the same shingles), n_links (other shingle sets that it is linked with), and, if asked for,
    text_hash (``xxhash64`` of the text), which tells rows of one id apart.

    Defined cases: null texts are empty; texts without words are copies if their bytes are equal, and have no links; texts of fewer
    words than a shingle are compared as a whole; very long texts are compared whole, and a group of them is dealt by its bytes;
    null ids never name a group unless all its ids are null, and a text that only null ids have is linked with none; rows of one id are each counted; an empty table gives no rows; other
    columns are left out.
    """
    rows = summarise(docs, id_col, text_col)
    classes = stored(rows.groupBy("digest").agg(
        F.min("id").alias("rep"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("labels").alias("labels")), "jaccard-classes")
    groups = stored(candidate_groups(classes.select("digest", "n", "labels"), threshold), "jaccard-candidates")
    wanted = groups.join(classes.select("digest", "rep", "n").hint("merge"), "digest")
    # Written, so that the join has both its sides from exchanges: a group that is hot is then split at run time.
    sizes = stored(wanted.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("size")), "jaccard-sizes")
    wanted = stored(wanted.join(sizes.hint("merge"), "comp").select("comp", "m", "size", "digest", "rep"), "jaccard-wanted")
    texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    few = wanted.count() <= BROADCAST_ROWS
    texts = texts.join(wanted.hint("broadcast" if few else "merge"), "rep")
    found = verify(texts.select("comp", "m", "size", "digest", "text"), threshold)
    links = found.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("n_links"))
    labels = components(found.where("b is not null").select("a", "b"), "jaccard-final").toDF("digest", "label")
    named = classes.select("digest", "rep", "n_copies").join(links, "digest", "left").join(labels, "digest", "left")
    named = named.withColumn("label", F.coalesce("label", "digest"))
    least = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "label").select("digest", "class_id", F.col("rep").alias("text_id"), "n_copies",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    out = rows.select("id", "digest", F.col("h").alias("text_hash")).join(named, "digest")
    return out.select(F.col("id").alias(id_col), "class_id", "text_id", "n_copies", "n_links", *["text_hash"] * hashed)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
