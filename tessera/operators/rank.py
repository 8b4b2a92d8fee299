"""Rank aggregation: hits (query_id, q_seg, label, score, doc_id, rank) to label scores for each query.

Every ranker is grouped aggregation with few rows per (query, label); ties in the final order go to the smaller label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import genus, name_words

QL = ["query_id", "label"]


def best(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*QL).agg(F.max("score").alias("score"))


def mean(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*QL).agg(F.avg("score").alias("score"))


def _by_score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("r", F.row_number().over(Window.partitionBy(*QL).orderBy(F.desc("score"), "q_seg", "doc_id")))


def topk_mean(hits: DataFrame, per_label_k: int = 3) -> DataFrame:
    return _by_score(hits).where(F.col("r") <= per_label_k).groupBy(*QL).agg(F.avg("score").alias("score"))


def hit(hits: DataFrame) -> DataFrame:
    """Query segments that found the label."""
    return hits.groupBy(*QL).agg(F.countDistinct("q_seg").cast("double").alias("score"))


def median(hits: DataFrame) -> DataFrame:
    return hits.groupBy(*QL).agg(F.median("score").alias("score"))


def threshold(hits: DataFrame, tau: float = 0.5) -> DataFrame:
    return mean(hits.where(F.col("score") >= tau))


def weighted_topk(hits: DataFrame, per_label_k: int = 5) -> DataFrame:
    """Weights fall evenly from 1 to 1/2."""
    top = _by_score(hits).where(F.col("r") <= per_label_k).withColumn("n", F.count("*").over(Window.partitionBy(*QL)))
    w = 1 - 0.5 * (F.col("r") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return top.withColumn("w", w).groupBy(*QL).agg((F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("score"))


def _softmaxed(hits: DataFrame, temperature: float) -> DataFrame:
    seg = Window.partitionBy("query_id", "q_seg")
    top = hits.withColumn("top", F.max("score").over(seg))
    top = top.withColumn("e", F.exp((F.col("score") - F.col("top")) / max(temperature, 1e-8)))
    return top.withColumn("p", F.col("e") / (F.sum("e").over(seg) + 1e-12))


def softmax(hits: DataFrame, temperature: float = 0.1) -> DataFrame:
    return _softmaxed(hits, temperature).groupBy(*QL).agg(F.sum("p").alias("score"))


def attention(hits: DataFrame, temperature: float = 0.05, weight_by_query_norm: bool = False) -> DataFrame:
    weight = F.col("top") if weight_by_query_norm else F.lit(1.0)
    return _softmaxed(hits, temperature).groupBy(*QL).agg(F.sum(F.col("p") * weight).alias("score"))


def _best_rank(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "q_seg", "label").agg(F.min(F.greatest(F.col("rank"), F.lit(1))).alias("best"))


def rrf(hits: DataFrame, k_const: int = 60) -> DataFrame:
    return _best_rank(hits).groupBy(*QL).agg(F.sum(1.0 / (k_const + F.col("best"))).alias("score"))


def borda(hits: DataFrame) -> DataFrame:
    size = hits.groupBy("query_id", "q_seg").agg(F.count("*").alias("n"))
    return _best_rank(hits).join(size, ["query_id", "q_seg"]).groupBy(*QL).agg(F.sum(F.greatest(F.col("n") - F.col("best"), F.lit(0))).cast("double").alias("score"))


def taxonomy_boost(hits: DataFrame, labels: DataFrame, genus_boost: float = 0.2, common_boost: float = 0.1) -> DataFrame:
    """Summed scores, and bonuses to labels related to the best one, labels without hits included.

    ``labels``: label, scientific_name, common_name of the corpus, a dimension table. Related labels come by equality of genus
    and of name words, not by comparing all labels with all queries.
    """
    base = hits.groupBy(*QL).agg(F.sum("score").alias("base"))
    top = base.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("base", 9)), "label"))).where("r = 1").select("query_id", F.col("label").alias("top"))
    info = labels.select("label", genus(F.col("scientific_name")).alias("genus"), name_words(F.col("common_name")).alias("words"))
    mine = top.join(info.toDF("top", "genus", "words"), "top", "left")
    same = mine.where("genus <> ''").join(info.where("genus <> ''").select(F.col("label"), "genus"), "genus").where("label <> top").select("query_id", "label", F.lit(genus_boost).alias("bonus"))
    shared = mine.select("query_id", "top", F.explode("words").alias("w")).join(info.select("label",
        F.explode("words").alias("w")), "w").where("label <> top").select("query_id", "label").distinct().withColumn("bonus", F.lit(common_boost))
    every = base.select("query_id", "label",
        F.col("base").alias("s")).unionByName(same.withColumnRenamed("bonus", "s")).unionByName(shared.withColumnRenamed("bonus", "s"))
    return every.groupBy(*QL).agg(F.sum("s").alias("score"))


def take_top_k(scored: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """The k best labels of each query: query_id, label, score (rounded), pos. Scores that differ by rounding errors alone are ties."""
    scored = scored.withColumn("score", F.round("score", 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return scored.withColumn("pos", F.row_number().over(order).cast("long")).where(F.col("pos") <= k).select("query_id", "label",
        F.round("score", digits).alias("score"), "pos")


def minmax(ranked: DataFrame) -> DataFrame:
    """Scores of a query's list between 0 and 1; all 1 if they are the same."""
    own = Window.partitionBy("query_id")
    low, high = F.min("score").over(own), F.max("score").over(own)
    return ranked.withColumn("norm", F.when(high - low < 1e-12, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def ensemble(members: list[tuple[DataFrame, float]], k: int = 10) -> DataFrame:
    """Weighted sum of normalised top-k lists; a label that a list lacks has 0 there."""
    parts = [minmax(take_top_k(scored, k)).select("query_id", "label", (F.col("norm") * w).alias("part")) for scored, w in members]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return take_top_k(both.groupBy(*QL).agg(F.sum("part").alias("score")), k)


RANKERS: dict[str, Callable[..., DataFrame]] = {
    "segment": best, "max": best, "mean": mean, "topk_mean": topk_mean, "hit": hit, "median": median, "threshold": threshold,
    "weighted_topk": weighted_topk,
    "softmax": softmax, "rrf": rrf, "borda": borda, "attention": attention, "taxonomy_boost": taxonomy_boost,
}
