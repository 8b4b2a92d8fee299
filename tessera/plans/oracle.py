"""Common table expressions that the SQL of many queries begins with."""

from __future__ import annotations

SEGMENTS = """
seg0 AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings),
segs AS (SELECT vec_id, label, embedding, CAST(rn % 4 AS BIGINT) AS seg_idx, min(vec_id) OVER (PARTITION BY label, rn // 4) AS item_id FROM seg0),
items AS (SELECT item_id, any_value(label) AS label FROM segs GROUP BY item_id),
ranked_items AS (SELECT item_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM items),
split AS (SELECT item_id, label, CASE WHEN n > 1 AND r <= greatest(1, least(CAST(round_even(n * 0.2, 0) AS BIGINT), n - 1)) THEN 'test' ELSE 'train' END AS part FROM ranked_items),
queries AS (SELECT item_id AS query_id, seg_idx AS q_seg, embedding, segs.label AS true_label FROM segs JOIN split USING (item_id) WHERE part = 'test'),
corpus AS (SELECT vec_id AS doc_id, item_id, seg_idx, segs.label AS label, embedding FROM segs JOIN split USING (item_id) WHERE part = 'train'),
truth AS (SELECT item_id AS query_id, label AS true_label FROM split WHERE part = 'test')
"""

SCORED = """
scored AS (SELECT query_id, q_seg, doc_id, corpus.label AS label, round(list_dot_product(queries.embedding, corpus.embedding), 12) AS score FROM queries, corpus)
"""

HITS = f"""{SEGMENTS}, {SCORED},
hits AS (SELECT query_id, q_seg, label, score, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, q_seg ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 100)
"""

TAXONOMY = """
tax AS (SELECT l.label, coalesce(p_type || ' ' || p_brand, '') AS scientific_name, coalesce(p_name, '') AS common_name FROM (SELECT DISTINCT CAST(label AS BIGINT) AS label FROM embeddings) l LEFT JOIN part ON p_partkey = l.label),
info AS (SELECT label, lower(split_part(trim(scientific_name), ' ', 1)) AS genus, list_filter(string_split(lower(trim(common_name)), ' '), lambda w: w <> '') AS words FROM tax)
"""


def taxonomy_scores(genus: float, common: float) -> str:
    """base, and the labels related to each query's best one."""
    return f"""
SELECT query_id, label, sum(s) AS score FROM (
  SELECT query_id, label, sum(score) AS s FROM hits GROUP BY query_id, label
  UNION ALL
  SELECT t.query_id, o.label, CASE WHEN o.genus <> '' AND o.genus = m.genus THEN {genus} ELSE 0 END + CASE WHEN list_has_any(o.words, m.words) THEN {common} ELSE 0 END
  FROM (SELECT query_id, label FROM (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(score), 9) DESC, label) AS r FROM hits GROUP BY query_id, label) WHERE r = 1) t
  JOIN info m ON m.label = t.label JOIN info o ON o.label <> t.label
  WHERE (o.genus <> '' AND o.genus = m.genus) OR list_has_any(o.words, m.words)) GROUP BY query_id, label
"""


BY_SCORE = "(SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, q_seg, doc_id) AS r FROM hits)"
BEST_RANK = "(SELECT query_id, q_seg, label, min(greatest(rank, 1)) AS best FROM hits GROUP BY query_id, q_seg, label)"


def _soft(t: float, weight: str = "1.0") -> str:
    return f"""SELECT query_id, label, sum(e / (total + 1e-12) * {weight}) AS score FROM (
  SELECT *, sum(e) OVER (PARTITION BY query_id, q_seg) AS total FROM (
    SELECT *, exp((score - top) / {t}) AS e FROM (SELECT *, max(score) OVER (PARTITION BY query_id, q_seg) AS top FROM hits))) GROUP BY query_id, label"""


def _mean(of: str) -> str:
    return f"SELECT query_id, label, avg(score) AS score FROM {of} GROUP BY query_id, label"


def _weighted(k: int) -> str:
    return f"""SELECT query_id, label, sum(score * w) / sum(w) AS score FROM (
  SELECT *, 1 - 0.5 * (r - 1) / greatest(count(*) OVER (PARTITION BY query_id, label) - 1, 1) AS w FROM {BY_SCORE} WHERE r <= {k}) GROUP BY query_id, label"""


def _rrf(k: int) -> str:
    return f"SELECT query_id, label, sum(1.0 / ({k} + best)) AS score FROM {BEST_RANK} GROUP BY query_id, label"


BORDA = f"""SELECT b.query_id, label, CAST(sum(greatest(n - best, 0)) AS DOUBLE) AS score FROM {BEST_RANK} b
JOIN (SELECT query_id, q_seg, count(*) AS n FROM hits GROUP BY query_id, q_seg) c ON b.query_id = c.query_id AND b.q_seg = c.q_seg GROUP BY b.query_id, label"""


def ranker(name: str, **p: float) -> str:
    """The score of each (query_id, label) by a ranker."""
    if name in ("max", "segment"):
        return "SELECT query_id, label, max(score) AS score FROM hits GROUP BY query_id, label"
    if name == "mean":
        return _mean("hits")
    if name == "topk_mean":
        return _mean(f"(SELECT * FROM {BY_SCORE} WHERE r <= {p.get('per_label_k', 3)})")
    if name == "hit":
        return "SELECT query_id, label, CAST(count(DISTINCT q_seg) AS DOUBLE) AS score FROM hits GROUP BY query_id, label"
    if name == "median":
        return "SELECT query_id, label, median(score) AS score FROM hits GROUP BY query_id, label"
    if name == "threshold":
        return _mean(f"(SELECT * FROM hits WHERE score >= {p.get('tau', 0.5)})")
    if name == "weighted_topk":
        return _weighted(int(p.get("per_label_k", 5)))
    if name == "softmax":
        return _soft(p.get("temperature", 0.1))
    if name == "attention":
        return _soft(p.get("temperature", 0.05), "top" if p.get("weight_by_query_norm") else "1.0")
    if name == "rrf":
        return _rrf(int(p.get("k_const", 60)))
    if name == "borda":
        return BORDA
    if name == "taxonomy_boost":
        return taxonomy_scores(p.get("genus_boost", 0.2), p.get("common_boost", 0.1))
    raise KeyError(name)


def top_k(scored: str, k: int = 10) -> str:
    return f"""SELECT query_id, label, score, pos FROM (
  SELECT query_id, label, round(round(score, 9), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, label) AS pos FROM ({scored})) WHERE pos <= {k}"""


def normalised(ranked: str) -> str:
    return f"""SELECT query_id, label, score, pos, CASE WHEN max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id) < 1e-12 THEN 1.0
  ELSE (score - min(score) OVER (PARTITION BY query_id)) / (max(score) OVER (PARTITION BY query_id) - min(score) OVER (PARTITION BY query_id)) END AS norm FROM ({ranked})"""


def vector_text(v: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x * {10**digits}, 0) AS BIGINT) AS VARCHAR)), ',')"


def unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_dot_product({v}, {v})), 1e-12))"
