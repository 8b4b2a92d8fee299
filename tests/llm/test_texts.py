"""Jaccard join, suffix dedup, BPE, decontamination, LM scoring, fingerprints: against brute force on small tables."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import bpe, decontaminate, imatch, jaccard_join, ngram_lm, shared, suffix_dedup

from .. import oracles
from . import fixtures

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def brute_groups(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([("", t or "")])
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], []).append(i)
    keys = list(classes)
    links, root = collections.Counter(), list(range(len(keys)))
    for a, b in itertools.combinations(range(len(keys)), 2):
        if len(keys[a] & keys[b]) / len(keys[a] | keys[b]) >= .8:
            links[a] += 1
            links[b] += 1
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
    least = {}
    for k, s in enumerate(keys):
        least[root[k]] = min(least.get(root[k], 1 << 60), classes[s][0])
    return {i: (least[root[k]], classes[s][0], len(classes[s]), links[k]) for k, s in enumerate(keys) for i in classes[s]}


def groups_of(df):
    return {r["doc_id"]: (r["class_id"], r["text_id"], r["n_copies"], r["n_links"]) for r in jaccard_join.jaccard_groups(df).collect()}


def test_groups_equal_brute_force(spark):
    rows = fixtures.documents()
    want = brute_groups(rows)
    assert any(n for *_, n in want.values())
    assert groups_of(fixtures.with_extras(fixtures.frame(spark, rows), "digest", "comp", "n", "keys")) == want


def test_split_buckets_and_tiles_change_nothing(spark, monkeypatch):
    base = fixtures.words(__import__("random").Random(3), 150)
    rows = [(k, " ".join([*base[:k], f"new{k}", *base[k + 1 :]]), "en", "s", 0) for k in range(40)]
    want = brute_groups(rows)
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert groups_of(fixtures.frame(spark, rows)) == want


def test_long_texts_are_dealt_by_their_bytes(spark, monkeypatch):
    base = fixtures.words(__import__("random").Random(4), 3000)
    rows = [(k, " ".join([*base[: 40 * k], f"new{k}", *base[40 * k + 1 :]]), "en", "s", 0) for k in range(12)]
    monkeypatch.setattr(jaccard_join, "TILE_BYTES", 60_000)
    assert groups_of(fixtures.frame(spark, rows)) == brute_groups(rows)


def test_links_near_the_threshold_are_found(spark):
    """Pairs of similarity 0.8 to 0.9, planted among texts that share half: at least the target recall, and no other links."""
    rng = __import__("random").Random(5)
    common = fixtures.words(rng, 60)
    rows = []
    for k in range(150):
        body = [*common, *fixtures.words(rng, 120, 50_000)]
        other = list(body)
        for _ in range(rng.choice([1, 2, 3])):
            other[rng.randrange(len(other))] = "changed"
        rows += [(2 * k, " ".join(body), "en", "s", 0), (2 * k + 1, " ".join(other), "en", "s", 0)]
    want, got = brute_groups(rows), groups_of(fixtures.frame(spark, rows))
    linked = sum(x[3] for x in want.values())
    assert linked > 250 and sum(x[3] for x in got.values()) >= .999 * linked and got == want


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "TASK_EDGES", most)
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (80, 2))] + [(200 + k, 201 + k) for k in range(40)]
    root = list(range(300))
    for a, b in pairs:
        low, high = sorted((root[a], root[b]))
        root = [low if x == high else x for x in root]
    got = {r["node"]: r["label"] for r in shared.components(spark.createDataFrame(pairs, "a long, b long"), "test").collect()}
    assert got == {x: root[x] for p in pairs for x in p if p[0] != p[1]}


def test_trie_walk_joins_all_links():
    """Members of one node in many labels: whatever is linked ends in one group."""
    rng = np.random.default_rng(6)
    a, b = jaccard_join._constants(jaccard_join.TREES * jaccard_join.DEEPEST)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = []
    for k in range(120):
        s = base.copy() if k % 2 else rng.integers(0, 2**63, 400).astype(np.uint64)
        s[rng.choice(400, rng.integers(0, 90), False)] = rng.integers(0, 2**63, 1)
        sets.append(np.unique(s))
    table = np.stack([jaccard_join.signature(s, a, b).astype(np.uint8) for s in sets])
    label = rng.integers(0, 4, len(sets)) << 8  # of one prefix
    order = np.argsort(label, kind="stable")
    group = np.arange(len(sets))
    jaccard_join.walk(table[order], label[order], group, np.zeros(len(sets)), 5, .8)
    for x, y in itertools.combinations(range(len(sets)), 2):
        p, q = set(sets[order[x]].tolist()), set(sets[order[y]].tolist())
        if len(p & q) / len(p | q) >= .8:
            assert group[x] == group[y]
    assert len(set(group.tolist())) > 50


def test_groups_of_nothing_and_of_repeated_rows(spark):
    assert groups_of(fixtures.frame(spark, [])) == {}
    rows = [(1, "a b c d e f g", "en", "s", 0)] * 3 + [(1, "quite another text of more words than that", "en", "s", 0),
        (None, "a b c d e f g", "en", "s", 0)]
    got = [(r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in jaccard_join.jaccard_groups(fixtures.frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 4, 0)] * 3 + [(None, 1, 4, 0), (1, 1, 1, 0)], key=repr)


def test_prefixes_are_as_long_as_recall_allows():
    d = jaccard_join.shortest()
    assert 1 - (1 - .8**d) ** jaccard_join.TREES >= jaccard_join.RECALL > 1 - (1 - .8 ** (d + 1)) ** jaccard_join.TREES


def brute_dedup(rows, keep, length=200):
    data = {(i, k): (t or "").encode() for k, (i, t, *_) in enumerate(rows)}
    count, first = collections.Counter(), {}
    for key in sorted(data):
        for p in range(len(data[key]) - length + 1):
            s = data[key][p : p + length]
            count[s] += 1
            first.setdefault(s, (key, p))
    out = []
    for key, raw in data.items():
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if count[s] > 1 and (keep == "none" or first[s] != (key, p)):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for p in range(len(raw)) if gone[p] and (not p or not gone[p - 1]))
        out.append((key[0], len(raw), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("meet", "block"), [(4096, 2 << 20), (1, 2 << 20), (2, 4000)])
def test_dedup_equals_brute_force(spark, keep, meet, block):
    rows = [*fixtures.documents(), (500, "ab" * 300, "en", "s", 0), (501, "é" * 150 + "x" * 220, "en", "s", 0),
        (502, "z" * 199, "en", "s", 0), (503, "z" * 199, "en", "s", 0)]
    passage = rows[0][1][-150:] + " " + "shared passage of all documents, cut off everywhere, " * 6
    rows += [(600 + k, f"{k} " * (k % 7) + passage[k % 5 : len(passage) - k % 11] + f" end {k}", "en", "s", 0) for k in range(30)]
    df = fixtures.with_extras(fixtures.frame(spark, rows), "key", "ctx", "n_bytes", "block").repartition(3)
    got = suffix_dedup.dedup(df, keep=keep, meet=meet, block_bytes=block).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_dedup(rows, keep)
    assert suffix_dedup.dedup(df.limit(0)).isEmpty()


def test_dedup_of_null_ids_repeated_rows_and_ids_of_letters(spark):
    text = fixtures.documents()[0][1] + "more than two hundred bytes " * 9
    rows = [(None, text, "en", "s", 0), (None, None, "en", "s", 0), (7, text, "en", "s", 0), (7, text, "en", "s", 0)]
    got = suffix_dedup.dedup(fixtures.frame(spark, rows).repartition(2)).collect()
    removed = sorted((r["n_removed"], r["doc_id"] is None) for r in got)
    assert len(got) == 4 and [x for x, null in removed if null and x] != [len(text)]  # the first copy, of null id, stays
    assert [x for x, null in removed if not null] == [len(text)] * 2
    named = spark.createDataFrame([("a", text), ("b", text), (None, text)], "doc_id string, text string")
    got = suffix_dedup.dedup(named).collect()
    assert sorted(r["n_removed"] == len(text) for r in got) == [False, True, True] and {r["doc_id"] for r in got} == {"a", "b", None}


@pytest.mark.parametrize("length", [3, 6, 11, 40])
def test_previous_factors_equal_brute_force(length):
    rng = np.random.default_rng(length)
    for raw in (np.frombuffer(b"banana bandana banana banana bandana bananas", np.uint8),
            rng.integers(97, 99, 300).astype(np.uint8), np.zeros(90, np.uint8)):
        starts = np.arange(len(raw) - length + 1)
        text = raw.tobytes()
        order, common = suffix_dedup.suffix_array(raw, starts, length)
        assert order.tolist() == sorted(range(len(starts)), key=lambda k: (text[k : k + length], k))
        def shared(p, q):
            return next((k for k in range(length) if text[p + k] != text[q + k]), length)
        assert common[1:].tolist() == [shared(p, q) for p, q in itertools.pairwise(order.tolist())]
        factor, twice = suffix_dedup.previous_factors(raw, starts, length)
        assert factor.tolist() == [max([shared(p, q) for q in range(p)], default=0) for p in range(len(starts))]
        assert twice.tolist() == [any(shared(p, q) == length for q in range(len(starts)) if q != p) for p in range(len(starts))]


@pytest.mark.parametrize("bits", [11, 5, 3])
def test_bpe_equals_the_library(bits, monkeypatch):
    from tokenizers import Tokenizer

    rng = __import__("random").Random(bits)
    letters = [*"ab Z'sé\n\t 12<|>　ß.,;!’ſ \xa0\x1c\x85漢😀", "<|endoftext|>", "'ll", " ", "  ", "the ", " of"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(300))) for _ in range(400)] + [None, "", "x" * 5000, " " * 500, "a b " * 2000]
    monkeypatch.setattr(bpe.cut_places, "__defaults__", (bits,))
    coder = bpe.Codec(bpe.default_vocabulary())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    ids = [x for _, part in bpe.encoded_batch(coder, batch, "text") for x in part]
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert ids == want
    assert [coder.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_bpe_query(spark):
    df = fixtures.with_extras(fixtures.frame(spark), "ids", "n_tokens", "_t")
    coded = bpe.encode_documents(df)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(coded).collect()}
    assert back == {i: t or "" for i, t, *_ in fixtures.documents()}
    lists = {r["doc_id"]: r["ids"] for r in coded.collect()}
    for r in bpe.digests(df).collect():
        ids = lists[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids),
            hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back[r["doc_id"]].encode()).hexdigest())
    assert bpe.digests(df.limit(0)).isEmpty()
    assert all(r["exact"] for r in bpe.tokenise(df, ["doc_id"]).collect())


def brute_hits(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        if i is not None and w:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    out = {}
    for d, t, *_ in rows:
        w, hit, found = WORD.findall(lower(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    rows = fixtures.documents()
    rows += [(900 + k, f"Before {t} after", "en", "s", 0) for k,
        t in enumerate([rows[1][1].upper(), "One-TWO", "one two", rows[2][1], rows[2][1] + " " + rows[2][1]])]
    items = [(1, rows[1][1]), (2, rows[2][1]), (3, "one two"), (4, "one two"), (5, None), (6, "..."), (None, rows[3][1]), (2, rows[2][1]),
        (7, "solo"), (8, rows[5][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(fixtures.with_extras(fixtures.frame(spark, rows),
        "items", "n_hit", "_whole"), bench).collect()}
    want = brute_hits(rows, items)
    assert {k: (r["n_words"], r["n_hit"], r["items"]) for k, r in got.items()} == want and sum(n for _, n, _ in want.values())
    assert got[901]["cleaned"] == "Before  after" and brute_hits([(0, got[900]["cleaned"])], items)[0][1] == 0
    assert decontaminate.decontaminate(fixtures.frame(spark, []), bench).isEmpty()
    assert {r["n_hit"] for r in decontaminate.decontaminate(fixtures.frame(spark, rows), bench.limit(0)).collect()} == {0}


def test_decontamination_equals_sql(spark):
    oracles.same(spark, decontaminate.op6_decontamination, decontaminate.SQL)


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 4, 300)
    text[[50, 120, 121, 200]] = 0
    codes = np.concatenate([[0], text, [0]])
    index = decontaminate.FMIndex(codes, 4)
    for n in (1, 2, 4):
        windows = np.array(list(itertools.product([1, 2, 3], repeat=n)))
        low, high = index.search(windows, np.full(len(windows), n))
        for w, a, b in zip(windows, low, high, strict=True):
            want = [k for k in range(len(codes) - n + 1) if (codes[k : k + n] == w).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_scores(tokens):
    """Scores from the definition: (learn, words with their end) -> score, and the probability of a word after two others."""
    counts = [collections.Counter() for _ in range(3)]
    for learn, words in tokens:
        if learn:
            padded = ["start", *words]
            counts[0].update(words)
            counts[1].update(zip(padded, words, strict=False))
            counts[2].update(zip(padded, words, words[1:], strict=False))
    total, texts, (mu2, mu3) = sum(counts[0].values()), sum(learn for learn, _ in tokens), ngram_lm.PRIOR

    def probability(u, v, w):
        p = (counts[0][w] + .1) / (total + .1 * (len(counts[0]) + 1))
        p = (counts[1][v, w] + mu2 * p) / ((texts if v == "start" else counts[0][v]) + mu2)
        return p if u is None else (counts[2][u, v, w] + mu3 * p) / (counts[1][u, v] + mu3)

    def score(words):
        padded = [None, "start", *words]
        return sum(math.log10(probability(*padded[k : k + 3])) for k in range(len(words)))
    return [score(words) for _, words in tokens], probability, counts[0]


def test_scores_equal_brute_force(spark):
    rows = [*fixtures.documents(), (None, "null id", "en", "s", 0), (1, "w1 w2", "en", "s", 0), (700, "w1 w2 " * 900, "en", "s", 0)]
    token = re.compile(r"[^\x20\x09-\x0D]+")
    tokens = [(i, [*token.findall(lower(t)), "\0end"]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    scores, _, count = brute_scores([(not held(i), ws) for i, ws in tokens])
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in ws) for _, ws in tokens]
    want = sorted(((i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(b, 6), round(s, 6)) for (i, ws), b,
        s in zip(tokens, base, scores, strict=True)), key=repr)
    df = fixtures.with_extras(fixtures.frame(spark, rows), "i", "h", "t", "score")
    for block, shard in ((8 << 20, 1_000_000), (2000, 500)):
        got = ngram_lm.score_documents(df, block_bytes=block, shard_keys=shard).collect()
        assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"],
            round(r["base_score"], 6), round(r["score"], 6)) for r in got), key=repr) == want
    assert ngram_lm.score_documents(df.limit(0)).isEmpty()


def test_scores_without_training_documents(spark):
    held = next(k for k in range(1000) if zlib.crc32(str(k).encode()) % 10 == 0)
    r = ngram_lm.score_documents(fixtures.frame(spark, [(held, "a b", "en", "s", 0)])).first()
    assert (r["train_tokens"], r["n_known"]) == (0, 0) and r["score"] == pytest.approx(r["base_score"]) == 0  # one class of unseen words


def test_model_beats_its_base_on_held_out_texts(spark):
    rows = ngram_lm.op7_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r["score"] for r in rows) > .8 * sum(r["base_score"] for r in rows)


def machine_of(texts, unseen=1):
    """An automaton over words 0.. of training texts; the last ``unseen`` words occur nowhere."""
    n = max(max(t) for t in texts) + 1 + unseen
    tokens, first = np.concatenate([np.array(t) for t in texts]), np.cumsum([0, *map(len, texts)])
    before = np.concatenate([[n, *t[:-1]] for t in texts])
    two, place = np.unique(before * n + tokens, return_inverse=True)
    spot = np.setdiff1d(np.arange(len(tokens)), first)
    three, place3 = np.unique(place[spot - 1] * n + tokens[spot], return_inverse=True)
    tail = np.empty(len(three), np.int64)
    tail[place3] = place[spot]
    count = {1: np.bincount(tokens, minlength=n), 2: np.bincount(place), 3: np.bincount(place3)}
    return ngram_lm.Automaton.of_counts({2: two, 3: three}, tail, count, len(tokens), len(texts), int((count[1] > 0).sum())), tokens, first


def test_every_state_is_a_distribution():
    rng = np.random.default_rng(1)
    end = 6  # which is no context
    machine, *_ = machine_of([[*rng.integers(0, end, 30).tolist(), end] for _ in range(4)])
    words = np.arange(machine.words)
    reached = machine.targets[machine.arcs % machine.words != end]
    assert len(reached) > 20
    for state in [0, *np.unique(reached).tolist(), 1 + machine.words]:
        _, weight = machine.move(np.full(len(words), state), words)
        assert (10**weight).sum() == pytest.approx(1)


@pytest.mark.parametrize("segment", [1, 2, 3, 7])
def test_long_texts_are_read_alike_from_several_places(segment):
    rng = np.random.default_rng(2)
    machine, tokens, first = machine_of([rng.integers(0, 9, n).tolist() for n in (1, 2, 50, 3, 17)])
    assert np.allclose(machine.read(tokens, first, segment), machine.read(tokens, first))


def hash64(b, seed=42):
    h = xxhash.xxh64_intdigest(b, seed)
    return h - 2**64 if h >= 2**63 else h


def edited_text(rows):
    """What each document's text becomes, and the next document's number, by descending id; null ids are last."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, hash64((rows[k][1] or "").encode())), reverse=True)
    out = {}
    for k, i in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        t, other = rows[i][1] or "", rows[nxt][1] or ""
        cut = len(t) // 3
        out[i] = (t[: len(t) - cut] + other[:cut], nxt)
    return out


def terms_in(text):
    return {hash64(w.encode()) for w in re.split(r"[\W_]+", text.lower()) if w}


def brute_prints(texts, documents):
    """Each text's lexicons with their terms, from the definition: terms in the band whose hashes lie in an interval."""
    df = collections.Counter(h for t in documents for h in terms_in(t))
    most = max(imatch.MIN_DF, int(imatch.MAX_SHARE * len(documents)))
    out = []
    for t in texts:
        own = sorted(h for h in terms_in(t) if imatch.MIN_DF <= df[h] <= most)
        lexicons = []
        for k in range(imatch.STARTS):
            start = -(2**63) + k * (2**64 // imatch.STARTS)
            for j in range(imatch.FINEST, imatch.STARTS.bit_length() - 2, -1):
                lexicons.append(tuple(h for h in own if start <= h < start + (1 << (64 - j))))
        out.append(lexicons)
    return out


def brute_likeness(p, q, x, y):
    if p == q and any(p) or not any(p) and x == y:
        return 1.0
    either = sum(bool(a or b) for a, b in zip(p, q, strict=True))
    differ = sum(a != b for a, b in zip(p, q, strict=True))
    return 1 - (2 ** (differ / imatch.STARTS) - 1) / (2 ** (either / imatch.STARTS) - 1) if either else 0.0


@pytest.mark.parametrize("ids", ["long", "string"])
def test_fingerprints_equal_brute_force(spark, monkeypatch, ids):
    monkeypatch.setattr(imatch, "RANGE_DOCS", 7)  # many ranges
    rows = [*fixtures.documents(), (300, "Ünïted Käse 漢字 w1 w2 " + fixtures.documents()[2][1], "de", "s", 0),
        (301, "käse 漢字 ünïted", "de", "s", 0), (None, "w1 w2 of a null id", "en", "s", 0), (None, None, "en", "s", 0), (5, "w1 again", "en", "s", 0)]
    if ids == "string":
        rows = [(None if r[0] is None else r[0] + 1000, *r[1:]) for r in rows]  # in the same order as strings
    want, texts = edited_text(rows), [r[1] or "" for r in rows]
    own, after = brute_prints(texts, texts), brute_prints([want[k][0] for k in range(len(rows))], texts)
    df = fixtures.with_extras(fixtures.frame(spark, rows), "bucket", "rn", "h", "tail", "df", "to", "gone")
    got = imatch.fingerprints(df.withColumn("doc_id", df["doc_id"].cast(ids))).collect()
    assert len(got) == len(rows)
    found = collections.defaultdict(list)
    for r in got:
        found[None if r["doc_id"] is None else int(r["doc_id"]), r["n_chars"], r["edited_sha256"]].append(r)
    shown = {}
    for k, t in enumerate(texts):
        edited, nxt = want[k]
        r = found[rows[k][0], len(t), hashlib.sha256(edited.encode()).hexdigest()].pop()
        for lexicons, text, print_ in ((own[k], t, r["fingerprint"]), (after[k], edited, r["edited_fingerprint"])):
            assert print_.startswith("text:") == (not any(lexicons))
            if any(lexicons):
                assert [bool(x) for x in print_.split(",")] == [bool(x) for x in lexicons]
            assert shown.setdefault(tuple(lexicons) if any(lexicons) else text, print_) == print_  # equal terms, equal fingerprints
        assert r["near_edited"] == pytest.approx(brute_likeness(own[k], after[k], t, edited))
        assert r["near_next"] == pytest.approx(brute_likeness(own[k], own[nxt], t, texts[nxt]))
    assert len(set(shown.values())) == len(shown)  # and others, others


def test_any_term_in_the_band_changes_the_querys_fingerprint(spark, tmp_path):
    body = [f"w{k}" for k in range(1000)]
    rows = [(0, " ".join(body), "en", "s", 0)] + [(k + 1, " ".join([*body[:k], "other", *body[k + 1 :]]), "en", "s", 0) for k in range(0, 1000, 100)]
    rows += [(2000 + k, f"filler{k}", "en", "s", 0) for k in range(300)]
    fixtures.frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["fingerprint"] for r in imatch.op10_fingerprints(spark, str(tmp_path)).collect()}
    assert len({got[r[0]] for r in rows[:11]}) == 11


def test_fingerprint_cases(spark):
    assert imatch.fingerprints(fixtures.frame(spark, [])).isEmpty()
    one = imatch.fingerprints(fixtures.frame(spark, [(1, "a b c d", "en", "s", 0)])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"a b ca ").hexdigest() and one["fingerprint"].startswith("text:")
    rows = [(1, "same text", "en", "s", 0), (1, "same text", "en", "s", 0), (None, "same text", "en", "s", 0), (None, None, "en", "s", 0)]
    got = imatch.fingerprints(fixtures.frame(spark, rows)).collect()
    assert len(got) == 4 and len({r["fingerprint"] for r in got if r["n_chars"]}) == 1


def test_fingerprint_plan_has_no_python(spark):
    plan = imatch.op10_fingerprints(spark, oracles.SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_near_texts_are_likelier_than_far_ones(spark):
    """Two thirds of a text are as they were, so about half of all terms are common."""
    r = imatch.op10_fingerprints(spark, "/root/testdata/sf0.01").selectExpr("avg(near_edited) AS e", "avg(near_next) AS n").first()
    assert r["e"] > .4 > .25 > 5 * r["n"]
