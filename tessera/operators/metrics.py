"""Retrieval metrics over ranked lists (query_id, label, score, pos) and truths (query_id, true_label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import genus, name_words

P_AT, R_AT = (1, 5), (1, 5, 10)


def per_query(ranked: DataFrame, truth: DataFrame, label_counts: DataFrame, p_at: tuple[int, ...] = P_AT, r_at: tuple[int, ...] = R_AT) -> DataFrame:
    """A row for each query, also those without predictions. A list has each label once, so average precision is the
    reciprocal rank; precision divides by the list's head, recall by the label's documents."""
    lists = ranked.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("pos") == 1, F.col("label"))).alias("top1"))
    found = ranked.join(truth, "query_id").where("label = true_label").groupBy("query_id").agg(F.min("pos").alias("at"))
    rows = truth.join(lists, "query_id", "left").join(found, "query_id", "left").join(label_counts.toDF("true_label", "docs"), "true_label", "left")
    at, n, docs = F.col("at"), F.coalesce("n", F.lit(0)), F.greatest(F.lit(1), F.coalesce("docs", F.lit(1)))
    rr = F.coalesce(1.0 / at, F.lit(0.0))
    out = {"ap": rr, "rr": rr, "ndcg": F.coalesce(1.0 / F.log2(at + 1.0), F.lit(0.0))}
    for k in p_at:
        out[f"p_at_{k}"] = F.when((at <= k) & (n > 0), 1.0 / F.least(n, F.lit(k))).otherwise(0.0)
    for k in r_at:
        out[f"r_at_{k}"] = F.when(at <= k, 1.0 / docs).otherwise(0.0)
    return rows.select("query_id", "true_label", F.col("top1").alias("top1_pred"), *[F.round(v, 9).alias(k) for k, v in out.items()])


def summary(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Means over queries, of all or of each group; 0 for none."""
    names = [c for c in rows.columns if c not in ("query_id", "true_label", "top1_pred", "system", *(groups or []))]
    return rows.groupBy(*(groups or [])).agg(F.count("*").alias("n_queries"),
        *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias({"ap": "map", "rr": "mrr"}.get(c, c)) for c in names])


def label_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("label").agg(F.count("*").alias("docs"))


def top_confusions(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent wrong first predictions; queries without one aren't counted."""
    wrong = rows.where("top1_pred IS NOT NULL AND top1_pred <> true_label")
    return wrong.groupBy("true_label", F.col("top1_pred").alias("pred_label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"),
        "true_label", "pred_label").limit(limit)


def all_confusions(rows: DataFrame, limit: int = 20) -> DataFrame:
    """As ``top_confusions``, with queries that have no prediction counted as an empty wrong one."""
    wrong = rows.withColumn("top1_pred",
        F.coalesce(F.col("top1_pred").cast("string"), F.lit(""))).where(F.col("top1_pred") != F.col("true_label").cast("string"))
    return wrong.groupBy("true_label", F.col("top1_pred").alias("pred_label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"),
        "true_label", "pred_label").limit(limit)


def confusion_matrix(rows: DataFrame, most: int = 30) -> DataFrame:
    """Shares of first predictions by true label, over the most frequent true labels on both sides."""
    top = rows.groupBy("true_label").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "true_label").limit(most).select("true_label")
    inside = rows.join(top, "true_label", "left_semi").join(top.toDF("top1_pred"), "top1_pred", "left_semi")
    counted = inside.groupBy("true_label", F.col("top1_pred").alias("pred_label")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("true_label")), 6))


def taxonomic_hits(ranked: DataFrame, truth: DataFrame, labels: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Shares of queries with a label of the true genus, or with a word of the true name, among the first k."""
    info = labels.select("label", genus(F.col("scientific_name")).alias("genus"), name_words(F.col("common_name")).alias("words"))
    pairs = truth.join(info.toDF("true_label",
        "true_genus", "true_words"), "true_label", "left").join(ranked, "query_id", "left").join(info, "label", "left")
    same = F.coalesce((F.col("genus") != "") & (F.col("genus") == F.col("true_genus")), F.lit(False))
    shared = F.coalesce(F.arrays_overlap("words", "true_words"), F.lit(False))
    flags = [f(k) for k in ks for f in (lambda k: F.max((same & (F.col("pos") <= k)).cast("int")).alias(f"g{k}"),
        lambda k: F.max((shared & (F.col("pos") <= k)).cast("int")).alias(f"c{k}"))]
    each = pairs.groupBy("query_id").agg(*flags)
    return each.agg(*[F.round(F.avg(F.coalesce(f"{s}{k}", F.lit(0))), 6).alias(f"{name}_at_{k}") for k in ks for s,
        name in (("g", "genus"), ("c", "common"))])


def multi_hit(hits: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """Metrics on hits that may repeat a label: average precision is divided by the relevant hits found."""
    own = Window.partitionBy("query_id").orderBy("rank")
    rows = hits.where(F.col("rank") <= k).join(truth, "query_id").withColumn("rel", (F.col("label") == F.col("true_label")).cast("int"))
    rows = rows.withColumn("seen", F.sum("rel").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    each = rows.groupBy("query_id").agg(
        F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("rank")).otherwise(0.0)).alias("s"), F.sum("rel").alias("found"),
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("at"), F.sum(F.when(F.col("rank") <= 5, F.col("rel")).otherwise(0)).alias("p5"),
        F.least(F.lit(5), F.count("*")).alias("n5"))
    each = truth.select("query_id").join(each, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return each.agg(
        F.count("*").alias("n_queries"), F.round(F.avg(zero(F.when(F.col("found") > 0, F.col("s") / F.col("found")))), 6).alias("map"),
        F.round(F.avg(zero(1.0 / F.col("at"))), 6).alias("mrr"), F.round(F.avg(zero(F.col("p5") / F.col("n5"))), 6).alias("p_at_5"),
        F.round(F.avg((F.coalesce("at", F.lit(99)) <= 1).cast("double")), 6).alias("top1"),
        F.round(F.avg((F.coalesce("at", F.lit(99)) <= 5).cast("double")), 6).alias("top5"))


def latency(values: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """n, mean, and linearly interpolated percentiles."""
    ps = [F.round(F.percentile(column, F.lit(p / 100)), 6).alias(f"p{p}_ms") for p in (50, 95, 99)]
    return values.groupBy(*groups).agg(F.count("*").alias("n"), F.round(F.avg(column), 6).alias("mean_ms"), *ps)
