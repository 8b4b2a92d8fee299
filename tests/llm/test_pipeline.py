"""The pipeline's stages against brute force on small tables."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from . import fixtures  # noqa: E402
from .test_texts import brute_dedup, brute_groups, brute_hits  # noqa: E402


def test_stages_in_order(spark, tmp_path):
    rows = fixtures.documents()
    items = [(1, rows[1][1]), (2, rows[2][1][:400])]
    rows = [*rows, (900, "Here " + rows[1][1], "en", "s0", 0), (950, "\u0001\u0002\u0003" * 300, None, "s0", 0), (3, rows[3][1], "en", "s0", 0)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = fixtures.with_extras(fixtures.frame(spark, rows), "digest", "cleaned")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = stages[name](spark, df, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    one = step("language", docs)
    assert one.columns == corpus_pipeline.COLUMNS
    kept = [tuple(r) for r in one.collect()]
    assert 950 not in {r[0] for r in kept} and len(kept) >= len(rows) - 6

    two = step("near_duplicates", one)
    groups = brute_groups(kept)
    assert sorted(r["doc_id"] for r in two.collect()) == sorted({g[0] for g in groups.values()})

    three = step("repeated_strings", two)
    want = {r[0]: r for r in brute_dedup([tuple(r) for r in two.collect()], "first")}
    before = {r["doc_id"]: r["text"] or "" for r in two.collect()}
    for r in three.collect():
        assert len(before[r["doc_id"]].encode()) - len(r["text"].encode()) >= want[r["doc_id"]][2] and r["n_chars"] == len(r["text"])
        if not want[r["doc_id"]][2]:
            assert r["text"] == before[r["doc_id"]]

    four = step("benchmark_passages", three)
    hits = brute_hits([tuple(r) for r in three.collect()], items)
    after = brute_hits([tuple(r) for r in four.collect()], items)
    assert sum(n for _, n, _ in hits.values()) and not sum(n for _, n, _ in after.values())
    assert all(after[d][0] == n - hit for d, (n, hit, _) in hits.items())

    five = step("token_ids", four).collect()
    assert len(five) == four.count() and all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in five)


def test_stages_keep_rows_of_null_and_repeated_ids(spark, tmp_path):
    """A copy goes by its own text: other rows of its id stay."""
    a, b, c, d = (" ".join(fixtures.words(__import__("random").Random(k), 90)) for k in range(4))
    rows = [(1, a, "en", "s", 0), (None, a, "en", "s", 0), (None, b, "en", "s", 0), (None, b, "en", "s", 0), (5, c, "en", "s", 0),
        (7, c + " end", "en", "s", 0), (7, d, "en", "s", 0), (7, d, "en", "s", 0), (None, None, None, None, None)]
    docs = fixtures.frame(spark, rows)
    spark.createDataFrame([(1, "none of these words at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    two = stages["near_duplicates"](spark, docs, str(tmp_path))
    kept = [(1, a), (None, b), (5, c), (7, d), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=repr) == sorted(kept, key=repr)
    for name in ("repeated_strings", "benchmark_passages"):
        two = stages[name](spark, two, str(tmp_path))
        assert sorted(((r["doc_id"], r["text"]) for r in two.collect()), key=repr) == sorted([(i, t or "") for i, t in kept], key=repr)
    assert stages["language"](spark, docs, str(tmp_path)).count() == len(rows)  # a row without a text is told by the others of its (empty) host
    assert stages["token_ids"](spark, two, str(tmp_path)).count() == 5


def test_empty_input(spark, tmp_path):
    fixtures.frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_few_rows_that_go_never_move_the_texts(spark, monkeypatch):
    """Whatever the session broadcasts by itself: the join is chosen by the number of rows, with the same result."""
    docs = spark.createDataFrame([(k if k % 5 else None, f"text {k}", "en", "s", 6) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    gone = docs.where("doc_id % 2 = 0 or text = 'text 10'").selectExpr("doc_id", "xxhash64(text)")
    want = sorted((f"text {k}" for k in range(60) if k != 10 and not (k % 5 and k % 2 == 0)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, join in ((1000, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(corpus_pipeline.jaccard_join, "BROADCAST_ROWS", rows)
            kept = corpus_pipeline._without(docs, gone)
            assert sorted(r["text"] for r in kept.collect()) == want
            assert join in kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
