"""Latency, paired tests, confidence intervals, and the data of plots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, stats
from ..sources.scratch import stored
from . import catalog_rank, derive, oracle

#: Systems that are compared.
SYSTEMS = [("rrf", {}), ("max", {}), ("borda", {}), ("hit", {})]


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency(derive.table(spark, sf_dir, "events"), "value", ["event_type"])


def ap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, system, value: average precision of each system on the same hits."""
    hits, labels, truth = stored(derive.hits(spark, sf_dir), "hits"), derive.taxonomy(spark, sf_dir), derive.truth(spark, sf_dir)
    counts = metrics.label_counts(derive.queries_and_corpus(spark, sf_dir)[1])
    out = None
    for name, params in SYSTEMS:
        ranked = catalog_rank.rank.take_top_k(catalog_rank.scored(hits, labels, name, params), 10)
        part = metrics.per_query(ranked, truth, counts).select("query_id", F.lit(name).alias("system"), F.col("ap").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, a, b. Systems meet by query, not by position."""
    values = ap_values(spark, sf_dir)
    a, b = (values.where(F.col("system") == s).select("query_id", F.col("value").alias(c)) for s, c in (("rrf", "a"), ("max", "b")))
    return a.join(b, "query_id")


def event_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events as pairs: enough of them for ties and both signs."""
    events = derive.table(spark, sf_dir, "events").select((F.col("event_id") / 2).cast("long").alias("query_id"),
        (F.col("event_id") % 2).alias("s"), F.round("value", 0).alias("v"))
    return events.groupBy("query_id").agg(F.max(F.when(F.col("s") == 0, F.col("v"))).alias("a"),
        F.max(F.when(F.col("s") == 1, F.col("v"))).alias("b")).where("a is not null and b is not null")


def wilcoxon_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = stats.wilcoxon(event_pairs(spark, sf_dir))
    return row.select("n", F.round("w_plus", 1).alias("w_plus"), F.round("w_minus", 1).alias("w_minus"), F.round("statistic", 1).alias("statistic"))


def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.wilcoxon_p(stats.wilcoxon(pairs(spark, sf_dir)))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("test"),
        ((F.col("n_nationkey") * 7 % 25 + 1) / 500.0).alias("p_raw"), ((F.col("n_nationkey") % 3) - 1.0).alias("delta_map"))


def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.holm(_tests(spark, sf_dir))
    return out.withColumn("winner", stats.winner(F.col("delta_map"), F.col("significant"))).withColumn("p_adjusted", F.round("p_adjusted", 9))


def friedman_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.friedman(ap_values(spark, sf_dir))


def friedman_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(p_value=[stats.chi2_tail(float(x), int(k) - 1) for x, k in zip(b["statistic"], b["n_systems"], strict=True)])

    return friedman_stat(spark, sf_dir).mapInPandas(work, "n_queries long, n_systems long, statistic double, p_value double")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.bootstrap(pairs(spark, sf_dir), "a")


def pair_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["attention", "softmax", "rrf", "borda", "max", "consensus"]
    every = [(b, s, r) for b in ("model_b", "model_a") for s in ("E1", "E2") for r in names]
    rows = F.array(*[F.struct(F.lit(b).alias("backbone"), F.lit(s).alias("strategy"), F.lit(r).alias("ranker")) for b, s, r in every])
    return stats.pair_groups(spark.range(1).select(F.inline(rows)), ("model_a", "model_b"))


def project_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two principal components, in place of a neighbour embedding."""
    rows = derive.table(spark, sf_dir, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="xy").fit(rows).transform(rows).withColumn("xy", vector_to_array("xy"))
    return out.select("vec_id", "label", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"))


def noise_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each type: points in the order of the level, as text."""
    events = derive.table(spark, sf_dir, "events").withColumn("snr_db", F.floor(F.col("value") / 100) * 100)
    points = events.groupBy("event_type", "snr_db").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("snr_db", "n"))),
        lambda p: F.concat_ws(":", p["snr_db"].cast("string"), p["n"].cast("string"))), " ")
    return points.groupBy("event_type").agg(text.alias("points"))


_VALUES = f"WITH {oracle.HITS}, " + ", ".join(f"r_{n} AS ({oracle.top_k(oracle.ranker(n, **p))})" for n, p in SYSTEMS) + ", vals AS (" + " UNION ALL ".join(
    f"SELECT t.query_id, '{n}' AS system, round(coalesce((SELECT 1.0 / min(pos) FROM r_{n} r WHERE r.query_id = t.query_id AND r.label = t.true_label), 0), 9) AS value FROM truth t" for n, _ in SYSTEMS) + ")"
QUERIES = {
    "latency_stats": latency_stats, "wilcoxon_stat": wilcoxon_stat, "wilcoxon_p": wilcoxon_p, "holm": holm, "friedman_stat": friedman_stat,
    "friedman_p": friedman_p, "bootstrap_ci": bootstrap_ci,
    "pair_groups": pair_groups, "project_2d": project_2d, "noise_curve": noise_curve, "ap_values": ap_values,
}
ORACLE = {
    "latency_stats": "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_ms, round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms FROM events GROUP BY event_type",
    "wilcoxon_stat": """WITH p AS (SELECT event_id // 2 AS q, max(CASE WHEN event_id % 2 = 0 THEN round(value, 0) END) AS a, max(CASE WHEN event_id % 2 = 1 THEN round(value, 0) END) AS b FROM events GROUP BY 1),
d AS (SELECT a - b AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS r FROM d),
s AS (SELECT count(*) AS n, CAST(coalesce(sum(r) FILTER (d > 0), 0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(r) FILTER (d < 0), 0) AS DOUBLE) AS w_minus FROM r)
SELECT n, round(w_plus, 1) AS w_plus, round(w_minus, 1) AS w_minus, round(least(w_plus, w_minus), 1) AS statistic FROM s""",
    "holm": """WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS test, (n_nationkey * 7 % 25 + 1) / 500.0 AS p_raw, (n_nationkey % 3) - 1.0 AS delta_map FROM nation),
s AS (SELECT *, least(1.0, p_raw * (count(*) OVER () - row_number() OVER (ORDER BY p_raw, test, delta_map) + 1)) AS s, row_number() OVER (ORDER BY p_raw, test, delta_map) AS r FROM t),
a AS (SELECT test, CAST(p_raw AS DOUBLE) AS p_raw, CAST(delta_map AS DOUBLE) AS delta_map, max(s) OVER (ORDER BY r) AS p_adjusted FROM s)
SELECT test, p_raw, delta_map, round(CAST(p_adjusted AS DOUBLE), 9) AS p_adjusted, p_adjusted < 0.05 AS significant, CASE WHEN NOT p_adjusted < 0.05 THEN 'tie' WHEN delta_map > 0 THEN 'a' WHEN delta_map < 0 THEN 'b' ELSE 'tie' END AS winner FROM a""",
    "friedman_stat": f"""{_VALUES}, r AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY value) + (count(*) OVER (PARTITION BY query_id, value) - 1) / 2.0 AS r FROM vals),
t AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS ties FROM (SELECT count(*) AS c FROM vals GROUP BY query_id, value)), z AS (SELECT count(DISTINCT query_id) AS n, count(DISTINCT system) AS k FROM vals),
q AS (SELECT CAST(sum(s * s) AS DOUBLE) AS squares FROM (SELECT sum(r) AS s FROM r GROUP BY system))
SELECT n AS n_queries, k AS n_systems, round((12.0 / (n * k * (k + 1)) * squares - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS statistic FROM z, q, t""",
    "pair_groups": """WITH n AS (SELECT b AS backbone, s AS strategy, r AS ranker, b || '__' || s || '__' || r AS key FROM (SELECT unnest(['model_b', 'model_a']) AS b), (SELECT unnest(['E1', 'E2']) AS s), (SELECT unnest(['attention', 'softmax', 'rrf', 'borda', 'max', 'consensus']) AS r)),
p AS (SELECT a.key AS key_a, b.key AS key_b, CASE WHEN a.strategy = b.strategy AND a.ranker = b.ranker AND a.backbone = 'model_a' AND b.backbone = 'model_b' THEN 1
  WHEN a.backbone = b.backbone AND a.ranker = b.ranker AND a.strategy = 'E1' AND b.strategy = 'E2' THEN 2
  WHEN a.backbone = b.backbone AND a.strategy = b.strategy AND a.ranker = 'attention' AND b.ranker <> 'attention' THEN 3
  WHEN a.backbone = b.backbone AND a.strategy = b.strategy AND a.ranker IN ('attention', 'softmax') AND b.ranker IN ('rrf', 'borda') THEN 4 END AS o FROM n a, n b)
SELECT key_a, key_b, ['backbone', 'strategy', 'reranker_vs_attention', 'score_vs_rank'][o] AS grp FROM p WHERE o IS NOT NULL""",
    "noise_curve": "SELECT event_type, string_agg(CAST(l AS BIGINT) || ':' || n, ' ' ORDER BY l) AS points FROM (SELECT event_type, floor(value / 100) * 100 AS l, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
    "ap_values": f"{_VALUES} SELECT * FROM vals",
}
