"""Hand-made cases, one for each trap of the semantics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalar, signal
from tessera.operators import ann, grouping, knn, metrics, pool, rank, represent, sample, segment, stats
from tessera.plans.registry import RANKERS, Registry, RetrievalSpec, retrieve
from tessera.sources import sinks


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id long, q_seg long, label string, score double, doc_id long, rank long")


@pytest.fixture(scope="module")
def two_segments(spark):
    return hits(spark, [(1, 0, "A", .9, 1, 1), (1, 0, "B", .8, 2, 2), (1, 0, "A", .7, 3, 3), (1, 1, "B", .95, 4, 1), (1, 1, "C", .5, 5, 2)])


def scores(df):
    return {r["label"]: round(r["score"], 9) for r in df.collect()}


def test_rankers_on_two_segments(two_segments):
    assert scores(rank.best(two_segments)) == {"A": .9, "B": .95, "C": .5}
    assert scores(rank.hit(two_segments)) == {"A": 1, "B": 2, "C": 1}
    assert scores(rank.borda(two_segments)) == {"A": 2, "B": 2, "C": 0}
    assert scores(rank.rrf(two_segments)) == {k: round(v, 9) for k, v in {"A": 1 / 61, "B": 1 / 62 + 1 / 61, "C": 1 / 62}.items()}
    assert scores(rank.threshold(two_segments, .5))["C"] == .5  # inclusive
    top = [(r["label"], r["pos"]) for r in rank.take_top_k(rank.borda(two_segments), 2).orderBy("pos").collect()]
    assert top == [("A", 1), ("B", 2)]  # a tie goes to the smaller label


def test_one_score_and_no_hits(spark):
    assert scores(rank.weighted_topk(hits(spark, [(1, 0, "A", .4, 1, 1)]))) == {"A": .4}
    none = hits(spark, [])
    for name in RANKERS:
        if name != "taxonomy_boost":
            assert RANKERS.get(name)(none).isEmpty()


def test_taxonomy_adds_labels_without_hits(spark):
    labels = spark.createDataFrame([("A", "X a", "red bird"), ("B", "X b", "blue"), ("C", "Y c", "red owl"), ("D", "Z d", "")],
        "label string, scientific_name string, common_name string")
    got = scores(rank.taxonomy_boost(hits(spark, [(1, 0, "A", .9, 1, 1)]), labels))
    assert got == {"A": .9, "B": .2, "C": .1}


def test_softmax_sums_to_the_segments(two_segments):
    assert sum(scores(rank.softmax(two_segments)).values()) == pytest.approx(2, abs=1e-6)


def test_minmax_of_equal_scores(spark):
    flat = rank.take_top_k(rank.best(hits(spark, [(1, 0, "A", .5, 1, 1), (1, 0, "B", .5, 2, 2)])))
    assert {r["norm"] for r in rank.minmax(flat).collect()} == {1.0}


def test_metrics_of_a_short_list_and_of_none(spark):
    ranked = spark.createDataFrame([(1, "A", 1.0, 1)], "query_id long, label string, score double, pos long")
    truth = spark.createDataFrame([(1, "A"), (2, "B")], "query_id long, true_label string")
    counts = spark.createDataFrame([("A", 4)], "label string, docs long")
    rows = {r["query_id"]: r for r in metrics.per_query(ranked, truth, counts).collect()}
    assert (rows[1]["p_at_5"], rows[1]["r_at_5"], rows[1]["ap"]) == (1.0, .25, 1.0)
    assert (rows[2]["p_at_5"], rows[2]["ap"], rows[2]["ndcg"], rows[2]["top1_pred"]) == (0.0, 0.0, 0.0, None)


def test_split_sizes(spark):
    rows = [(f"{n}-{k}", str(n)) for n in (1, 2, 3, 8, 13) for k in range(n)]
    out = sample.stratified_split(spark.createDataFrame(rows, "id string, label string"), "id", "label", .2)
    got = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.sum((F.col("part") == "test").cast("int")).alias("n")).collect()}
    assert got == {"1": 0, "2": 1, "3": 1, "8": 2, "13": 3}


def test_sample_takes_each_label_first(spark):
    rows = spark.createDataFrame([(k, "ab"[k % 5 == 0]) for k in range(50)], "id long, label string")
    got = [r["label"] for r in sample.stratified_sample(rows, "id", "label", 6).collect()]
    assert sorted(got) == ["a"] * 3 + ["b"] * 3


def starts(df):
    return [(r["start_sample"], r["end_sample"]) for r in df.orderBy("seg_idx").collect()]


def test_windows(spark):
    long = spark.createDataFrame([(1, [float(k) for k in range(12)])], "user_id long, samples array<double>")
    short = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "user_id long, samples array<double>")
    assert starts(segment.overlapping(long, 5, 2)) == [(0, 5), (2, 7), (4, 9), (6, 11), (7, 12)]
    assert starts(segment.fixed(long, 5)) == [(0, 5), (5, 10), (10, 15)]
    assert starts(segment.fixed(long, 5, pad_last=False)) == [(0, 5), (5, 10), (10, 12)]
    assert starts(segment.fixed(long, 5, drop_last_short=True)) == [(0, 5), (5, 10)]
    assert starts(segment.overlapping(short, 5, 2)) == [(0, 5)]
    assert segment.overlapping(short, 5, 2).first()["audio"] == [1.0, 2.0, 3.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        segment.overlapping(long, 5, 6)


def test_energy_windows_do_not_overlap(spark):
    y = np.zeros(100)
    y[40:44] = 5
    y[80:84] = 9
    rows = segment.energy(spark.createDataFrame([(1, y.tolist())], "user_id long, samples array<double>"), 20, 4)
    got = starts(rows)
    assert (72, 92) in got and all(b[0] >= a[1] for a, b in zip(got, got[1:], strict=False))


def test_event_windows(spark):
    y = np.zeros(200)
    y[100:110] = 3
    got = starts(segment.event(spark.createDataFrame([(1, y.tolist()), ], "user_id long, samples array<double>"), 20, 5, min_gap=10))
    assert got == [(90, 110)]
    assert starts(segment.event(spark.createDataFrame([(1, [0.0] * 50)], "user_id long, samples array<double>"), 20, 5)) == [(15, 35)]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "g long, idx long, embedding array<double>")


def test_pyramid_of_fewer_rows_than_cells(spark):
    rows = vectors(spark, [(1, k, [float(k + 1), 0.0]) for k in range(3)])
    got = np.array(pool.pyramid(rows, ["g"], (4,)).first()["pooled"]).reshape(4, 2)[:, 0]
    assert np.allclose(got / got[0], [1, 2, 3, 3])  # edges 0, 1, 2, 2, 3: the empty cell has the last row


def test_pyramid_of_one_level_is_the_mean(spark):
    rows = vectors(spark, [(1, k, [math.sin(k), math.cos(3 * k)]) for k in range(7)])
    assert np.allclose(pool.pyramid(rows, ["g"], (1,)).first()["pooled"], pool.mean(rows, ["g"]).first()["pooled"])
    with pytest.raises(ValueError):
        pool.pyramid(rows, ["g"], (0,))


def test_holm(spark):
    got = {r["k"]: round(r["p_adjusted"], 9) for r in stats.holm(spark.createDataFrame([("a", .01), ("b", .04), ("c", .03)],
        "k string, p_raw double")).collect()}
    assert got == {"a": .03, "b": .06, "c": .06}


def test_wilcoxon_by_hand(spark):
    pairs = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate([(5, 1), (3, 4), (7, 5), (2, 2), (9, 6), (8, 3)])],
        "query_id long, a double, b double")
    row = stats.wilcoxon_p(stats.wilcoxon(pairs)).first()
    assert (row["n"], row["w_plus"], row["w_minus"]) == (5, 14.0, 1.0)
    assert row["p_value"] == pytest.approx(4 / 32)
    zero = stats.wilcoxon_p(stats.wilcoxon(spark.createDataFrame([(1, 1.0, 1.0)], "query_id long, a double, b double"))).first()
    assert (zero["statistic"], zero["p_value"]) == (0.0, 1.0)


def test_chi2_tail():
    assert stats.chi2_tail(5.991465, 2) == pytest.approx(.05, abs=1e-6)
    assert stats.chi2_tail(7.814728, 3) == pytest.approx(.05, abs=1e-6)
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(.05, abs=1e-6)


def test_bootstrap_holds_the_mean(spark):
    rows = spark.createDataFrame([(k, float(k % 10)) for k in range(300)], "query_id long, v double")
    r = stats.bootstrap(rows, "v", 200).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 1.5


def test_bootstrap_resamples_as_often_as_the_reference(spark):
    rows = spark.createDataFrame([(k, float(k * k % 17)) for k in range(20)], "query_id long, v double")
    assert stats.bootstrap(rows, "v").first() == stats.bootstrap(rows, "v", 5000).first() != stats.bootstrap(rows, "v", 1000).first()


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((240, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(k, k % 6, x.tolist()) for k, x in enumerate(v[:200])], "doc_id long, label long, embedding array<double>")
    queries = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v[200:])], "query_id long, q_seg long, embedding array<double>")
    return v, corpus, queries


def test_knn_equals_numpy(space):
    v, corpus, queries = space
    got = {(r["query_id"], r["rank"]): r["doc_id"] for r in knn.knn(queries, corpus, 5).collect()}
    best = np.argsort(-(v[200:] @ v[:200].T), axis=1)[:, :5]
    assert got == {(q, k + 1): int(best[q, k]) for q in range(40) for k in range(5)}


def test_approximate_search_finds_enough(space):
    _, corpus, queries = space
    exact = knn.knn(queries, corpus, 10)
    for found in (ann.ivf(queries, corpus, ann.fitted_centres(corpus, 14), 10, nprobe=10), ann.ivfpq(queries, corpus, 10, m=8)):
        assert ann.recall(found, exact).first()["recall"] >= .9
    with pytest.raises(ValueError):
        ann.ivfpq(queries, corpus, 10, m=5)


def test_best_rows_of_scores_in_any_order():
    """Ties, infinite and missing scores; sorted so that every row is better than those before, and at random."""
    rng = np.random.default_rng(3)
    for k, scores in ((3, np.sort(rng.integers(0, 40, (50, 900)) / 8.0, axis=1)), (7, rng.standard_normal((50, 900))), (5, np.ones((50, 900)))):
        scores[0, :] = -np.inf
        scores[1, 5:] = np.nan
        docs = rng.permutation(900)
        best = knn.Best(50, docs, k, 12)
        for rows in (np.arange(0, 50, 2), np.arange(1, 50, 2)):
            for at in range(0, 900, 90):
                best.add(rows, at, scores[rows, at : at + 90])
        row, col, score = best.cut()
        rounded = np.round(scores, 12)
        want = [(r, c) for r in range(50) for c in sorted(np.flatnonzero(np.isfinite(scores[r])), key=lambda c: (-rounded[r, c], docs[c]))[:k]]
        assert list(zip(row.tolist(), col.tolist(), strict=True)) == want and (score == rounded[row, col]).all()


def test_lists_meet_in_matrices(spark, space):
    """No row for a pair of a query and a corpus row: the probed lists as numpy finds them, and no join in the plan."""
    v, corpus, queries = space
    centres = ann.seed_centres(corpus, 14)
    c = np.array([r["centre"] for r in centres.orderBy("list_id").collect()])
    found = ann.ivf(queries, corpus, centres, 10, nprobe=4)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    own = np.round(v[:200] @ c.T, 12).argmax(1)
    want = set()
    for q in range(40):
        probed = np.argsort(-np.round(v[200 + q] @ c.T, 12), kind="stable")[:4]
        near = sorted((-round(float(v[200 + q] @ v[d]), 12), d) for d in np.flatnonzero(np.isin(own, probed)).tolist())[:10]
        want |= {(q, d, k + 1) for k, (_, d) in enumerate(near)}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in found.collect()} == want


def test_dense_ids_and_grouped_ranks(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("x"), (F.col("id") % 3).alias("g"))
    assert [r["n"] for r in grouping.dense_ids(rows, ["x"], "n").orderBy("x").collect()] == list(range(100))
    ranked = grouping.grouped_rank(rows, ["g"],
        F.floor(F.col("x") / 10), [F.col("x")], "r").groupBy("g").agg(F.array_sort(F.collect_list("r")).alias("r")).collect()
    assert all(r["r"] == list(range(1, len(r["r"]) + 1)) for r in ranked)


def test_dense_ids_of_wide_rows(spark):
    """Ranges are merged by the bytes of the columns that are read: rows and counts must have the same ones."""
    rows = spark.range(40000).select((F.col("id") * 7 % 40000).alias("x"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.rand(1)).alias("v"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    try:
        ids = grouping.dense_ids(rows, ["x"], "n").select("x", "n", F.size("v").alias("size")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(ids) == [(k, k, 64) for k in range(40000)]


def test_clusters_of_a_label(spark):
    rows = [(k, 0, 1, [1.0, .01 * k] if k % 2 else [-1.0, .01 * k]) for k in range(10)]
    segs = spark.createDataFrame(rows, "item_id long, seg_idx long, label long, embedding array<double>")
    docs = represent.cluster(segs, 2).collect()
    assert len(docs) == 2 and sorted(len(d["source_record_ids"]) for d in docs) == [5, 5]


def test_bandpass_keeps_the_band():
    t = np.arange(2000) / 1000
    inside, outside = np.sin(2 * np.pi * 50 * t), np.sin(2 * np.pi * 300 * t)
    y = signal.bandpass(inside + outside, 1000, 20, 100)
    assert np.abs(y - inside)[300:-300].max() < .05
    assert signal.bandpass(inside, 1000, 400, 100) is inside


def test_stft_round_trip_and_gate():
    y = np.random.default_rng(0).standard_normal(5000)
    assert np.allclose(signal.istft(signal.stft(y, 512, 128), 512, 128, 5000), y, atol=1e-8)
    assert np.abs(signal.gate(y)).mean() < np.abs(y).mean()


def test_noise(spark):
    assert np.array_equal(signal.white(50, 3), signal.white(50, 3)) and signal.pink(4096, 1).std() == pytest.approx(1, abs=1e-6)
    row = spark.createDataFrame([([3.0, -3.0, 3.0, -3.0], [1.0, 1.0, 1.0, 1.0])],
        "a array<double>, n array<double>").select(signal.mix(F.col("a"), F.col("n"), 0.0).alias("m")).first()
    assert row["m"] == pytest.approx([6.0, 0.0, 6.0, 0.0], abs=1e-9)


def test_scalars(spark):
    row = spark.createDataFrame([("  Turdus merula", "x")], "s string, r string").select(scalar.genus(F.col("s")).alias("g"),
        scalar.safe_double(F.col("r")).alias("d"), scalar.genus(F.lit("")).alias("e")).first()
    assert (row["g"], row["d"], row["e"]) == ("turdus", 0.0, "")


def test_registries_and_specification(spark, space):
    r = Registry("thing", {"a": len})
    with pytest.raises(KeyError, match="there are: a"):
        r.get("b")
    with pytest.raises(KeyError):
        r.register("a")(len)
    with pytest.raises(KeyError):
        RetrievalSpec.of({"rankng": "rrf"})
    _, corpus, queries = space
    segs = corpus.select(F.floor(F.col("doc_id") / 4).alias("item_id"), (F.col("doc_id") % 4).alias("seg_idx"), "label", "embedding")
    spec = RetrievalSpec.of({"representation": "audio", "fusion": {"type": "early"}, "ranking": {"type": "max"}, "top_k": 3})
    assert retrieve(spec, segs, queries).count() == 120


def test_json_text():
    assert sinks.json_text({"a": np.float32(.5), "b": [np.int64(3)]}) == '{\n  "a": 0.5,\n  "b": [\n    3\n  ]\n}'


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.windows import windowed

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windowed(stream, "6 hours").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("w")) == key(windowed(events, "6 hours"))
