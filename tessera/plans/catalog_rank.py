"""Similarity joins, rank aggregation, ensembles and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ann, fuse, knn, metrics, rank
from . import derive, oracle
from ..sources.scratch import stored
from .registry import INDEXES
from .derive import TOP_K

HITS, TAX, SEGMENTS = oracle.HITS, oracle.TAXONOMY, oracle.SEGMENTS

#: Share of the lists that are probed where centres aren't fitted.
SEED_PROBED = 0.8

#: Rankers by query name; the same parameters go to the SQL.
RANKED = {
    "rank_max": ("max", {}), "rank_mean": ("mean", {}), "rank_topk_mean": ("topk_mean", {"per_label_k": 3}), "rank_hit": ("hit", {}),
    "rank_median": ("median", {}),
    "rank_threshold": ("threshold", {"tau": 0.2}), "rank_weighted_topk": ("weighted_topk", {"per_label_k": 5}),
    "rank_softmax": ("softmax", {"temperature": 0.1}),
    "rank_rrf": ("rrf", {"k_const": 60}), "rank_borda": ("borda", {}), "rank_attention": ("attention", {"temperature": 0.05}),
    "rank_attention_weighted": ("attention", {"temperature": 0.05, "weight_by_query_norm": True}),
    "rank_taxonomy_boost": ("taxonomy_boost", {"genus_boost": 0.2, "common_boost": 0.1}),
}
ATT, SOFT, RRF, BORDA = ("attention", {"temperature": 0.05,
    "weight_by_query_norm": True}), ("softmax", {"temperature": 0.1}), ("rrf", {"k_const": 60}), ("borda", {})


def _tax(genus: float, common: float) -> tuple[str, dict]:
    return "taxonomy_boost", {"genus_boost": genus, "common_boost": common}


#: The named ensembles' members and weights.
ENSEMBLES = {
    "ens_att_rrf_tax": [(0.45, *ATT), (0.35, *RRF), (0.20, *_tax(0.20, 0.10))],
    "ens_sm_rrf_tax": [(0.40, *SOFT), (0.35, *RRF), (0.25, *_tax(0.20, 0.10))],
    "ens_att_sm_tax": [(0.40, *ATT), (0.35, *SOFT), (0.25, *_tax(0.25, 0.10))],
    "ens_rrf_borda_tax": [(0.40, *RRF), (0.35, *BORDA), (0.25, *_tax(0.25, 0.15))],
    "ens_consensus": [(0.20, *ATT), (0.20, *SOFT), (0.20, *RRF), (0.15, *BORDA), (0.25, *_tax(0.30, 0.15))],
    "ens_tax_strong": [(0.30, *ATT), (0.30, *RRF), (0.40, *_tax(0.40, 0.20))],
}
#: The parameter grid of the ranker sweep.
SWEEP = [
    ("softmax", {"temperature": 0.1}), ("attention", {"temperature": 0.05, "weight_by_query_norm": True}),
    ("attention", {"temperature": 0.10, "weight_by_query_norm": True}),
    ("rrf", {"k_const": 60}), ("rrf", {"k_const": 30}), ("borda", {}), ("topk_mean", {"per_label_k": 3}), ("topk_mean", {"per_label_k": 5}),
    ("weighted_topk", {"per_label_k": 5}), ("weighted_topk", {"per_label_k": 7}), _tax(0.20, 0.10), _tax(0.35, 0.15), _tax(0.10, 0.05),
]


def scored(hits: DataFrame, labels: DataFrame | None, name: str, params: dict) -> DataFrame:
    if name == "taxonomy_boost":
        return rank.taxonomy_boost(hits, labels, **params)
    return rank.RANKERS[name](hits, **params)


def ranked(spark: SparkSession, sf_dir: str, name: str, params: dict) -> DataFrame:
    return rank.take_top_k(scored(derive.hits(spark, sf_dir), derive.taxonomy(spark, sf_dir), name, params), TOP_K)


def system_name(name: str, params: dict) -> str:
    return "_".join([name, *[f"{k}={float(v):g}" for k, v in params.items()]])


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rankers of the grid on the same hits."""
    hits, labels = stored(derive.hits(spark, sf_dir), "hits"), derive.taxonomy(spark, sf_dir)
    out = None
    for name, params in SWEEP:
        part = rank.take_top_k(scored(hits, labels, name, params), TOP_K).select(F.lit(system_name(name, params)).alias("system"),
            "query_id", "label", "score", "pos")
        out = part if out is None else out.unionByName(part)
    return out


def ensemble(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    hits, labels = derive.hits(spark, sf_dir), derive.taxonomy(spark, sf_dir)
    return rank.ensemble([(scored(hits, labels, name, params), w) for w, name, params in ENSEMBLES[key]], TOP_K)


def _ensemble_sql(key: str) -> str:
    parts = " UNION ALL ".join(f"SELECT query_id, label, norm * {w} AS part FROM ({oracle.normalised(oracle.top_k(oracle.ranker(name, **params)))})" for w, name, params in ENSEMBLES[key])
    return f"WITH {HITS}, {TAX} " + oracle.top_k(f"SELECT query_id, label, sum(part) AS score FROM ({parts}) GROUP BY query_id, label")


def knn_rows(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        queries, corpus = derive.queries_and_corpus(spark, sf_dir)
        return knn.knn(queries, corpus, TOP_K, metric).select("query_id", "q_seg", "doc_id", "label", F.round("score", 6).alias("score"), "rank")
    return run


def _knn_sql(score: str, where: str = "", having: str = "", digits: int = 6) -> str:
    return f"""WITH {SEGMENTS} SELECT query_id, q_seg, doc_id, label, round(s, {digits}) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, q_seg ORDER BY s DESC, doc_id) AS rank FROM (
    SELECT query_id, q_seg, doc_id, corpus.label AS label, round({score}, 12) AS s FROM queries, corpus {where})) WHERE rank <= 10"""


DOT = "list_dot_product(queries.embedding, corpus.embedding)"
L2 = "-list_sum(list_transform(list_zip(queries.embedding, corpus.embedding), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def knn_exclude_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments searched among all segments but those of their own recording."""
    segs = derive.segments(spark, sf_dir)
    queries = segs.select(F.col("item_id").alias("query_id"), F.col("seg_idx").alias("q_seg"), "embedding")
    corpus = segs.select(F.col("vec_id").alias("doc_id"), "label", "embedding", "item_id")
    return knn.knn(queries, corpus, 5, exclude="item_id").select("query_id", "q_seg", "doc_id", "label", F.round("score", 6).alias("score"), "rank")


def knn_es_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search server answers: the best of 100 candidates, with its score (1 + cosine) / 2."""
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    hits = INDEXES.get("es")(queries, corpus, TOP_K, num_candidates=100)
    return hits.select("query_id", "q_seg", "doc_id", "label", F.round((1 + F.col("score")) / 2, 6).alias("es_score"),
        F.round("score", 6).alias("score"), "rank")


def _ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    centres = ann.seed_centres(corpus, ann.list_count(corpus.count()))
    return ann.ivf(queries, corpus, centres, TOP_K, ann.probe_count(centres.count(), SEED_PROBED))


def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverted lists around centres that are the corpus rows with the least hashes; so many are probed that the recall is over 0.9."""
    return _ivf(spark, sf_dir).select("query_id", "q_seg", "doc_id", "label", F.round("score", 6).alias("score"), "rank")


def knn_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In place of a graph index: inverted lists around fitted centres."""
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    return INDEXES.get("hnsw")(queries, corpus, TOP_K)


def index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the exact hits that each approximate index finds, with the parameters of the queries above."""
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    exact = stored(knn.knn(queries, corpus, TOP_K), "exact")  # what each index is held against
    out = None
    for name, found in (("ivf", _ivf(spark, sf_dir)), ("hnsw", knn_ann(spark, sf_dir)), ("ivfpq", knn_ivfpq(spark, sf_dir))):
        row = ann.recall(found, exact).select(F.lit(name).alias("index"), "n", F.round("recall", 6).alias("recall"))
        out = row if out is None else out.unionByName(row)
    return out


def knn_ivfpq(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    return ann.ivfpq(queries, corpus, TOP_K)


def index_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = derive.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).cast("long").alias("dim"))
    n, dim = F.col("n"), F.col("dim")
    kinds = [("flat", n * dim * 4), ("ivf", n * dim * 4), ("hnsw", n * dim * 4 + n * 32 * 8), ("ivfpq", n * 16 * 1)]
    return size.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"),
        v.cast("long").alias("bytes")) for k, v in kinds])).alias("x")).select("x.kind", "x.bytes")


def retrieve_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    hits = knn.knn(fuse.early(queries), corpus, knn.candidates(TOP_K, corpus.count()))
    return rank.take_top_k(rank.best(hits), TOP_K)


def retrieve_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.take_top_k(rank.rrf(derive.hits(spark, sf_dir)), TOP_K)


EARLY = f"""{SEGMENTS},
pooled AS (SELECT query_id, list(v ORDER BY i) AS m FROM (SELECT query_id, i, avg(embedding[i]) AS v FROM (SELECT query_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM queries) GROUP BY query_id, i) GROUP BY query_id),
early AS (SELECT query_id, {oracle.unit('m')} AS embedding FROM pooled),
hits AS (SELECT query_id, q_seg, label, score, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT query_id, 0 AS q_seg, doc_id, label, round(list_dot_product(early.embedding, corpus.embedding), 12) AS score FROM early, corpus)) WHERE rank <= 100)
"""


def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.minmax(ranked(spark, sf_dir, "rrf", {"k_const": 60})).withColumn("norm", F.round("norm", 6))


def metric_rows(spark: SparkSession, sf_dir: str, name: str = "rrf", params: dict | None = None) -> DataFrame:
    """A row of metrics for each query."""
    _, corpus = derive.queries_and_corpus(spark, sf_dir)
    return metrics.per_query(ranked(spark, sf_dir, name, params or {}), derive.truth(spark, sf_dir), metrics.label_counts(corpus))


def metric_sql(scores: str) -> str:
    """CTEs up to ``rows``: metrics of each query."""
    return f"""ranked AS ({oracle.top_k(scores)}),
lists AS (SELECT query_id, count(*) AS n, max(CASE WHEN pos = 1 THEN label END) AS top1 FROM ranked GROUP BY query_id),
found AS (SELECT r.query_id, min(pos) AS place FROM ranked r JOIN truth t ON r.query_id = t.query_id AND label = true_label GROUP BY r.query_id),
docs AS (SELECT label, count(*) AS docs FROM corpus GROUP BY label),
rows AS (SELECT t.query_id, t.true_label, top1 AS top1_pred, round(coalesce(1.0 / place, 0), 9) AS ap, round(coalesce(1.0 / place, 0), 9) AS rr, round(coalesce(1.0 / log2(place + 1.0), 0), 9) AS ndcg,
  {', '.join(f"round(CASE WHEN place <= {k} AND n > 0 THEN 1.0 / least(n, {k}) ELSE 0 END, 9) AS p_at_{k}" for k in metrics.P_AT)},
  {', '.join(f"round(CASE WHEN place <= {k} THEN 1.0 / greatest(1, coalesce(docs, 1)) ELSE 0 END, 9) AS r_at_{k}" for k in metrics.R_AT)}
  FROM truth t LEFT JOIN lists USING (query_id) LEFT JOIN found USING (query_id) LEFT JOIN docs ON docs.label = t.true_label)"""


ROWS = f"WITH {HITS}, {metric_sql(oracle.ranker('rrf'))}"
_MEANS = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {n}" for c,
    n in [("ap", "map"), ("rr", "mrr"), ("ndcg", "ndcg"), *[(f"p_at_{k}", f"p_at_{k}") for k in metrics.P_AT],
    *[(f"r_at_{k}", f"r_at_{k}") for k in metrics.R_AT]])


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(metric_rows(spark, sf_dir))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_counts(derive.queries_and_corpus(spark, sf_dir)[1])


def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_confusions(metric_rows(spark, sf_dir))


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_matrix(metric_rows(spark, sf_dir))


def taxonomic_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.taxonomic_hits(ranked(spark, sf_dir, "rrf", {}), derive.truth(spark, sf_dir), derive.taxonomy(spark, sf_dir))


def legacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector for each recording, pooled from all its segments; hits not reduced to labels."""
    queries, corpus = derive.queries_and_corpus(spark, sf_dir)
    hits = knn.knn(fuse.early(queries), corpus, TOP_K)
    return metrics.multi_hit(hits, derive.truth(spark, sf_dir), TOP_K)


def _taxonomic_sql() -> str:
    flags = ", ".join(f"max(CASE WHEN i.genus <> '' AND i.genus = t.genus AND pos <= {k} THEN 1 ELSE 0 END) AS g{k}, max(CASE WHEN list_has_any(i.words, t.words) AND pos <= {k} THEN 1 ELSE 0 END) AS c{k}" for k in (1, 5, 10))
    means = ", ".join(f"round(avg(coalesce(g{k}, 0)), 6) AS genus_at_{k}, round(avg(coalesce(c{k}, 0)), 6) AS common_at_{k}" for k in (1, 5, 10))
    return f"""{ROWS}, {TAX} SELECT {means} FROM (SELECT tr.query_id, {flags} FROM truth tr LEFT JOIN info t ON t.label = tr.true_label LEFT JOIN ranked r ON r.query_id = tr.query_id LEFT JOIN info i ON i.label = r.label GROUP BY tr.query_id)"""


QUERIES = {
    **{k: (lambda s, d, n=n, p=p: ranked(s, d, n, p)) for k, (n, p) in RANKED.items()},
    **{k: (lambda s, d, k=k: ensemble(s, d, k)) for k in ENSEMBLES},
    "sweep_rankers": sweep, "minmax_norm": minmax_norm,
    "knn_flat_cosine": knn_rows("cosine"), "knn_flat_l2": knn_rows("l2"), "knn_exclude_self": knn_exclude_self,
    "knn_es_score": knn_es_score, "knn_ivf": knn_ivf, "knn_ann": knn_ann, "knn_ivfpq": knn_ivfpq, "index_recall": index_recall,
    "index_footprint": index_footprint, "retrieve_early": retrieve_early, "retrieve_late": retrieve_late,
    "per_query_metrics": metric_rows, "eval_summary": eval_summary, "label_counts": label_counts, "top_confusions": top_confusions,
    "confusion_matrix": confusion_matrix,
    "taxonomic_hits": taxonomic_hits, "legacy_metrics": legacy_metrics,
}
ORACLE = {
    **{k: f"WITH {HITS}, {TAX} " + oracle.top_k(oracle.ranker(n, **p)) for k, (n, p) in RANKED.items()},
    **{k: _ensemble_sql(k) for k in ENSEMBLES},
    "sweep_rankers": f"WITH {HITS}, {TAX} " + " UNION ALL ".join(f"SELECT '{system_name(n, p)}' AS system, query_id, label, score, pos FROM ({oracle.top_k(oracle.ranker(n, **p))})" for n, p in SWEEP),
    "minmax_norm": f"WITH {HITS} SELECT query_id, label, score, pos, round(norm, 6) AS norm FROM (" + oracle.normalised(oracle.top_k(oracle.ranker("rrf"))) + ")",
    "knn_flat_cosine": _knn_sql(DOT), "knn_flat_l2": _knn_sql(L2),
    "knn_exclude_self": f"""WITH {SEGMENTS} SELECT query_id, q_seg, doc_id, label, round(s, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, q_seg ORDER BY s DESC, doc_id) AS rank FROM (
    SELECT a.item_id AS query_id, a.seg_idx AS q_seg, b.vec_id AS doc_id, b.label AS label, round(list_dot_product(a.embedding, b.embedding), 12) AS s FROM segs a JOIN segs b ON a.item_id <> b.item_id)) WHERE rank <= 5""",
    "knn_es_score": f"SELECT query_id, q_seg, doc_id, label, round((1 + s) / 2, 6) AS es_score, round(s, 6) AS score, rank FROM (WITH {SEGMENTS}, {oracle.SCORED} SELECT *, score AS s, row_number() OVER (PARTITION BY query_id, q_seg ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10",
    "knn_ivf": f"""WITH {SEGMENTS},
lists AS (SELECT r - 1 AS list_id, embedding AS centre FROM (SELECT embedding, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM corpus) WHERE r <= (SELECT greatest(1, CAST(floor(sqrt(count(*)) + 0.5) AS BIGINT)) FROM corpus)),
own AS (SELECT doc_id, label, embedding, list_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, list_id) AS r FROM (SELECT c.*, list_id, round(list_dot_product(c.embedding, centre), 12) AS s FROM corpus c, lists)) WHERE r = 1),
probes AS (SELECT query_id, q_seg, embedding, list_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_seg ORDER BY s DESC, list_id) AS r FROM (SELECT q.*, list_id, round(list_dot_product(q.embedding, centre), 12) AS s FROM queries q, lists)) WHERE r <= (SELECT greatest(least(8, count(*)), CAST(ceil(0.8 * count(*)) AS BIGINT)) FROM lists))
SELECT query_id, q_seg, doc_id, label, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_seg ORDER BY s DESC, doc_id) AS rank FROM (
  SELECT query_id, q_seg, doc_id, label, round(list_dot_product(p.embedding, o.embedding), 12) AS s FROM probes p JOIN own o USING (list_id))) WHERE rank <= 10""",
    "index_footprint": "WITH s AS (SELECT count(*) AS n, max(len(embedding)) AS dim FROM embeddings) SELECT 'flat' AS kind, n * dim * 4 AS bytes FROM s UNION ALL SELECT 'ivf', n * dim * 4 FROM s UNION ALL SELECT 'hnsw', n * dim * 4 + n * 32 * 8 FROM s UNION ALL SELECT 'ivfpq', n * 16 FROM s",
    "retrieve_early": f"WITH {EARLY} " + oracle.top_k(oracle.ranker("max")),
    "retrieve_late": f"WITH {HITS} " + oracle.top_k(oracle.ranker("rrf")),
    "per_query_metrics": f"{ROWS} SELECT * FROM rows",
    "eval_summary": f"{ROWS} SELECT count(*) AS n_queries, {_MEANS} FROM rows",
    "label_counts": f"WITH {SEGMENTS} SELECT label, count(*) AS docs FROM corpus GROUP BY label",
    "top_confusions": f"{ROWS} SELECT true_label, top1_pred AS pred_label, count(*) AS n FROM rows WHERE top1_pred <> true_label GROUP BY ALL ORDER BY n DESC, true_label, pred_label LIMIT 20",
    "confusion_matrix": f"""{ROWS}, top AS (SELECT true_label FROM rows GROUP BY true_label ORDER BY count(*) DESC, true_label LIMIT 30),
c AS (SELECT true_label, top1_pred AS pred_label, count(*) AS n FROM rows WHERE true_label IN (FROM top) AND top1_pred IN (FROM top) GROUP BY ALL)
SELECT true_label, pred_label, n, round(n / sum(n) OVER (PARTITION BY true_label), 6) AS share FROM c""",
    "taxonomic_hits": _taxonomic_sql(),
    "legacy_metrics": f"""WITH {EARLY},
h AS (SELECT s.*, CAST(s.label = t.true_label AS INT) AS rel FROM hits s JOIN truth t USING (query_id) WHERE rank <= 10),
c AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h),
e AS (SELECT query_id, sum(CASE WHEN rel = 1 THEN seen / rank ELSE 0 END) AS s, sum(rel) AS found, min(CASE WHEN rel = 1 THEN rank END) AS place, sum(CASE WHEN rank <= 5 THEN rel ELSE 0 END) AS p5, least(5, count(*)) AS n5 FROM c GROUP BY query_id)
SELECT count(*) AS n_queries, round(avg(CASE WHEN found > 0 THEN s / found ELSE 0 END), 6) AS map, round(avg(coalesce(1.0 / place, 0)), 6) AS mrr, round(avg(coalesce(p5 / n5, 0)), 6) AS p_at_5,
  round(avg(CASE WHEN place <= 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN place <= 5 THEN 1 ELSE 0 END), 6) AS top5 FROM truth LEFT JOIN e USING (query_id)""",
}
