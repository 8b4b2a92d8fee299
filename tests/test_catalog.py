"""Queries against their SQL; a few of each kind here, all of them in the driver's run."""

import pytest

from tessera.plans import catalog

from . import oracles

FAST = [
    "scan_semi_join", "safe_parse", "cache_key", "cache_probe", "json_report", "sink_roundtrip", "rating_filter", "strat_sample",
    "strat_split", "genus", "compare_pivot",
    "seg_fixed", "seg_overlap", "seg_multiscale", "seg_energy", "seg_event", "decode_wav", "frame_rms", "min_gap_events", "win_tumbling",
    "win_sliding", "l2_normalize", "pad_crop", "pool_mean", "pool_spe", "pool_attention",
    "doc_prototype", "knn_flat_cosine", "knn_flat_l2", "knn_ivf", "knn_es_score", "legacy_metrics", "rank_rrf", "rank_borda",
    "rank_taxonomy_boost", "ens_consensus", "eval_summary", "latency_stats", "wilcoxon_stat", "holm", "pair_groups", "noise_curve", "mix_snr",
]


@pytest.mark.parametrize("name", FAST)
def test_query_equals_its_sql(spark, name):
    assert oracles.same(spark, catalog.QUERIES[name], catalog.ORACLE[name]) > 0


def test_all_sql_belongs_to_a_query():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert {"ap", "ndcg", "p_at_1"} <= set(entry.entry(spark).columns)
    assert set(entry.oracle_sql()) <= set(entry.queries())
