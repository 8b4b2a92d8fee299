"""Whole runs of the engine, stages by key, caches, reports, and searches at their bounds."""

import io
import json
import wave
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import signal
from tessera.operators import ann, knn, represent
from tessera.plans import catalog_rank, experiment
from tessera.plans.registry import EMBEDDERS, RetrievalSpec, retrieve
from tessera.sources import records, scratch

RATE = 400


@pytest.fixture(scope="module")
def recordings(spark):
    """Tones of three labels, four recordings each, and one without samples."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(12):
        t = np.arange(RATE * (2 + k % 3)) / RATE
        y = np.sin(2 * np.pi * (20, 60, 140)[k % 3] * t) + .05 * rng.standard_normal(len(t))
        rows.append((k, f"species {k % 3}", [float(v) for v in y], f"Genus{k % 3} name", f"common {k % 3}", 4.0))
    rows.append((12, "species 0", [], "", "", 5.0))
    rows.append((13, "species 1", [1.0] * 900, "", "", 1.0))  # of a low rating
    return spark.createDataFrame(rows,
        "item_id long, label string, samples array<double>, scientific_name string, common_name string, rating double").cache()


def config(**own):
    return {"name": "t", "data": {"sample_rate": RATE, "min_rating": 3.0, "train_ratio": 0.7},
        "segmentation": {"type": "fixed", "params": {"window_sec": 1.0}}, "embedding": "logmel",
            "representation": "segment", "indexing": "flat", "fusion": "late", "ranking": "max", "evaluation": {"top_k": 3}, **own}


FAMILIES = {
    "baseline": config(representation="audio", fusion={"type": "early", "params": {"aggregator": "mean"}}),
    "segments": config(segmentation={"type": "overlapping", "params": {"window_sec": 1.0, "hop_sec": 0.5, "pad_last": True}},
    preprocessing={"type": "bandpass", "params": {"low_hz": 5.0, "high_hz": 180.0}},
                       ranking={"type": "rrf", "params": {"k_const": 60}},
                       indexing={"type": "hnsw", "params": {"M": 32, "ef_construction": 200, "ef_search": 64}}),
    "super-embedding": config(representation="audio", aggregation={"type": "topk_mean", "params": {"k": 2}},
        fusion={"type": "early", "params": {"aggregator": "max"}}),
    "species": config(representation="species", preprocessing={"type": "spectral_gating", "params": {"prop_decrease": 1.0,
    "n_std_thresh": 1.5, "stationary": True}}, similarity="l2"),
    "clusters": config(representation={"type": "cluster", "params": {"n_clusters": 2}},
    segmentation={"type": "energy", "params": {"window_sec": 0.5, "frame_sec": 0.1}},
                       ranking={"type": "taxonomy_boost", "params": {"genus_boost": 0.2, "common_name_boost": 0.1}}),
}


@pytest.mark.parametrize("name", FAMILIES)
def test_runs_find_the_labels(recordings, name):
    run = experiment.run(experiment.ExperimentSpec.of(FAMILIES[name]), recordings)
    assert (run.facts["n_train"], run.facts["n_test"]) == (9, 3)
    assert run.summary["n_queries"] == 3 and run.summary["mrr"] > .6 and run.facts["n_documents"] > 2


def test_a_run_with_noise_cache_and_reports(spark, recordings, tmp_path):
    yaml = pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(config(evaluation={"top_k": 3,
        "noise": {"enabled": True, "noise_types": ["white", "rain"], "snr_db": [20.0, -40.0]}})))
    spec = experiment.ExperimentSpec.load(tmp_path / "c.yaml")
    clips = spark.createDataFrame([("rain", [float(v) for v in np.random.default_rng(3).standard_normal(300)])], "kind string, samples array<double>")
    cache = f"file://{tmp_path}/cache"
    run = experiment.run(spec, recordings, clips, cache)
    rows = {(r["noise_type"], r["snr_db"]): r["map"] for r in run.noise}
    assert set(rows) == {(t, s) for t in ("white", "rain") for s in (20.0, -40.0)} and rows["white", 20.0] >= rows["white", -40.0]
    written = spark.read.parquet(cache).count()
    again = experiment.run(spec, recordings, clips, cache)  # all embeddings are read
    assert spark.read.parquet(cache).count() == written and again.summary == run.summary
    out = run.save(tmp_path / "results")
    report = json.loads((out / "report.json").read_text())
    assert report["clean"]["n_queries"] == 3 and report["config"]["name"] == "t" and len(report["noise"]) == 4 and report["embedding_dim"] == 64
    assert spark.read.option("header", True).csv(f"file://{out}/per_query_clean.csv").count() == 3
    assert {r["record_id"] for r in spark.read.json(f"file://{out}/rankings_clean.json").collect()} == {r["query_id"] for r in run.per_query.collect()}
    assert len((out / "noise_robustness.csv").read_text().splitlines()) == 5 and (out / "top_confusions.csv").exists()
    with pytest.raises(ValueError, match="clips"):
        experiment.noisy(recordings, ("rain",), (0.0,), 1)


def test_settings_are_checked():
    for wrong in ({"nmae": "x"}, {"data": {"rate": 1}}, {"evaluation": {"noise": {"kinds": []}}}):
        with pytest.raises(KeyError):
            experiment.ExperimentSpec.of(config(**wrong))
    with pytest.raises(ValueError):
        experiment.ExperimentSpec.of(config(similarity="l1"))
    with pytest.raises(KeyError):
        experiment.ExperimentSpec.of({"ranking": "max"})


def test_an_empty_corpus_is_an_error(spark, recordings):
    with pytest.raises(ValueError, match="empty"):
        experiment.run(experiment.ExperimentSpec.of(config()), recordings.limit(0))


def test_documents_have_the_first_recordings_names(recordings):
    segs = experiment.embedded(recordings, experiment.ExperimentSpec.of(config())).join(recordings.select("item_id", "label"), "item_id")
    docs = represent.named(represent.species(segs), recordings).collect()
    assert {(d["label"], d["scientific_name"], d["common_name"]) for d in docs} == {(f"species {k}",
        f"Genus{k} name", f"common {k}") for k in range(3)}


def test_aggregators_by_key(spark, recordings):
    segs = experiment.embedded(recordings, experiment.ExperimentSpec.of(config())).join(recordings.select("item_id", "label"), "item_id")
    queries = segs.select(F.col("item_id").alias("query_id"), F.col("seg_idx").alias("q_seg"), "embedding")
    spec = RetrievalSpec.of({"representation": {"type": "audio", "params": {"aggregator": "median"}},
        "fusion": {"type": "early", "params": {"aggregator": "topk_mean", "aggregator_params": {"k": 2}}}, "ranking": "max", "top_k": 2})
    assert retrieve(spec, segs, queries).where("pos = 1").count() == 13
    assert EMBEDDERS.keys() == ["logmel", "projection"]


def test_null_and_uneven_embeddings(spark):
    corpus = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, None), (3, 2, []), (4, 2, [0.0, 1.0])],
        "doc_id long, label long, embedding array<double>")
    queries = spark.createDataFrame([(1, 0, [1.0, 0.1]), (2, 0, None)], "query_id long, q_seg long, embedding array<double>")
    assert [(r["query_id"], r["doc_id"]) for r in knn.knn(queries, corpus, 5).orderBy("rank").collect()] == [(1, 1), (1, 4)]
    assert ann.ivf(queries, corpus, ann.fitted_centres(corpus, 1), 5, 1).count() == 2
    assert knn.knn(queries.limit(0), corpus, 5).isEmpty()
    with pytest.raises(Exception, match="same length"):
        knn.knn(queries, corpus.union(spark.createDataFrame([(5, 1, [1.0])], corpus.schema)).coalesce(1), 5).collect()


def test_queries_in_many_blocks_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((90, 8))
    corpus = spark.createDataFrame([(k, k % 3, x.tolist()) for k, x in enumerate(v[:60])],
        "doc_id long, label long, embedding array<double>").repartition(3)
    queries = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v[60:])], "query_id long, q_seg long, embedding array<double>")
    monkeypatch.setattr(knn, "HELD_BYTES", 1)
    want = {(q, int(d)) for q, row in enumerate(np.argsort(-(v[60:] @ v[:60].T), axis=1)[:, :4]) for d in row}
    assert {(r["query_id"], r["doc_id"]) for r in knn.knn(queries, corpus, 4).collect()} == want


def test_a_written_index_finds_what_it_found_before(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((130, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(k, f"l{k % 3}", x.tolist()) for k, x in enumerate(v[:100])],
        "doc_id long, label string, embedding array<double>")
    queries = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(v[100:])], "query_id long, q_seg long, embedding array<double>")
    ann.save_index(corpus, f"file://{tmp_path}/index", 8)
    found = ann.search_index(queries, f"file://{tmp_path}/index", 5, 8)
    exact = knn.knn(queries, corpus, 5)
    assert ann.recall(found, exact).first()["recall"] == 1 and found.count() == 150 and found.schema["label"].dataType.simpleString() == "string"


def wav(y, rate=RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.asarray(y) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_recordings_of_archives(spark, tmp_path):
    """Files that aren't there go, samples are drawn before the rating filter, unknown ratings stay, ids are dense."""
    lines = ["filename,primary_label,scientific_name,common_name,rating"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for k in range(8):
            lines.append(f"s{k % 2}/{k}.wav,s{k % 2},Genus g{k % 2},name,{(0, 1, 4, 5)[k % 4]}")
            if k != 7:
                z.writestr(f"train_audio/s{k % 2}/{k}.wav", wav(np.sin(np.arange(40) / (k + 1))))
        z.writestr("train.csv", "\n".join(lines))
    rows = records.load(spark, f"file://{tmp_path}/a.zip", min_rating=3.0).orderBy("item_id").collect()
    assert [(r["item_id"], r["rel_path"], r["rating"]) for r in rows] == [(0, "train_audio/s0/0.wav", 0.0),
        (1, "train_audio/s0/2.wav", 4.0), (2, "train_audio/s0/4.wav", 0.0), (3, "train_audio/s0/6.wav", 4.0), (4, "train_audio/s1/3.wav", 5.0)]
    few = records.load(spark, f"file://{tmp_path}/a.zip", max_records=4).groupBy("primary_label").count().collect()
    assert sorted(r["count"] for r in few) == [2, 2]
    audio = {r["rel_path"]: len(r["samples"]) for r in records.zip_audio(spark, f"file://{tmp_path}/a.zip", RATE).collect()}
    assert len(audio) == 7 and set(audio.values()) == {40}


def test_noise_clips(spark, tmp_path):
    (tmp_path / "wind").mkdir()
    for name in ("rain1.wav", "rain2.wav", "wind/x.wav", "other.wav"):
        (tmp_path / name).write_bytes(wav(np.ones(30) / 2))
    clips = records.noise_clips(spark, f"file://{tmp_path}", ["rain", "wind"], RATE)
    assert sorted(r["kind"] for r in clips.collect()) == ["rain", "rain", "wind"]
    with pytest.raises(FileNotFoundError, match="urban"):
        records.noise_clips(spark, f"file://{tmp_path}", ["urban"], RATE)


def test_searches_of_a_stream(spark, tmp_path):
    from tessera.streaming.windows import search_stream

    rng = np.random.default_rng(6)
    corpus = spark.createDataFrame([(k, k % 2, x.tolist()) for k, x in enumerate(rng.standard_normal((20, 4)))],
        "doc_id long, label long, embedding array<double>")
    queries = spark.createDataFrame([(k, 0, x.tolist()) for k, x in enumerate(rng.standard_normal((6, 4)))],
        "query_id long, q_seg long, embedding array<double>")
    queries.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(queries.schema).parquet(f"{tmp_path}/in")
    running = search_stream(stream, lambda df: knn.knn(df, corpus, 3), f"{tmp_path}/out", f"{tmp_path}/state").start()
    running.processAllAvailable()
    running.stop()
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"]) for r in df.collect())
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(knn.knn(queries, corpus, 3))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_registered_indexes(spark, sf):
    rows = {r["index"]: r["recall"] for r in catalog_rank.index_recall(spark, f"/root/testdata/{sf}").collect()}
    assert set(rows) == {"ivf", "hnsw", "ivfpq"} and min(rows.values()) >= .9


def test_recall_searches_exactly_once(spark, monkeypatch):
    rows, search = spark.sparkContext.accumulator(0), knn.knn

    def counted(*args, **kwargs):
        found = search(*args, **kwargs)

        def see(batches):
            for b in batches:
                rows.add(b.num_rows)
                yield b
        return found.mapInArrow(see, found.schema)

    monkeypatch.setattr(catalog_rank.knn, "knn", counted)
    recalls = catalog_rank.index_recall(spark, "/root/testdata/sf0.001").collect()
    assert {r["n"] for r in recalls} == {rows.value}


@pytest.mark.parametrize("n", [1, 5, 255, 256, 1000])
def test_filter_by_blocks_equals_the_recurrence(n):
    sections = signal.butter_sections(.1, .5, 4)
    x = np.random.default_rng(n).standard_normal(n) + 1
    want = x
    for b0, b1, b2, _, a1, a2 in sections:
        level = (b0 + b1 + b2) / (1 + a1 + a2) * want[0]
        z2 = b2 * want[0] - a2 * level
        z1 = b1 * want[0] - a1 * level + z2
        out = []
        for v in want:
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            out.append(y)
        want = np.array(out)
    assert np.allclose(signal._filtered(sections, x), want, atol=1e-9)


def test_scratch_is_deleted(spark):
    with scratch.scratch():
        path = scratch.work_path(spark, "gone")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    system, place = scratch.filesystem(path)
    assert system.get_file_info(place).type.name == "NotFound"
