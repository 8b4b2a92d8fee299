"""Recordings, splits, queries and corpus from the driver's tables.

An embedding row is a segment; four neighbouring segments of a label are a recording, named by its least vec_id. A fifth of a
label's recordings, in the order of a hash, are queries; the segments of the others are the corpus. A label's taxonomy is
the part of that key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import knn, sample
from ..operators.grouping import grouped_rank
from ..sources.scratch import stored

SEGMENTS_PER_RECORDING, TOP_K = 4, 10
#: Segments with their part, written once a session and folder: application, folder -> table.
_split: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, embedding, seg_idx, item_id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), "embedding")
    ranked = grouped_rank(rows, ["label"], F.floor(F.col("vec_id") / 1024), [F.col("vec_id")], "rn")
    ranked = ranked.withColumn("rec_no", F.floor((F.col("rn") - 1) / SEGMENTS_PER_RECORDING)).withColumn("seg_idx",
        (F.col("rn") - 1) % SEGMENTS_PER_RECORDING)
    return ranked.withColumn("item_id", F.min("vec_id").over(Window.partitionBy("label", "rec_no"))).drop("rn", "rec_no")


def split(segs: DataFrame) -> DataFrame:
    """item_id, part."""
    items = segs.groupBy("item_id").agg(F.first("label").alias("label"))
    return sample.stratified_split(items, "item_id", "label", 0.2).select("item_id", "part")


def queries_and_corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _split:  # read several times: counted, searched, judged
        segs = segments(spark, sf_dir)
        _split[at] = stored(segs.join(split(segs), "item_id"), "split")
    both = _split[at]
    queries = both.where("part = 'test'").select(F.col("item_id").alias("query_id"), F.col("seg_idx").alias("q_seg"), "embedding",
        F.col("label").alias("true_label"))
    corpus = both.where("part = 'train'").select(F.col("vec_id").alias("doc_id"), "item_id", "seg_idx", "label", "embedding")
    return queries, corpus


def hits(spark: SparkSession, sf_dir: str, metric: str = "cosine") -> DataFrame:
    """Late fusion: each query segment's hits."""
    queries, corpus = queries_and_corpus(spark, sf_dir)
    return knn.knn(queries, corpus, knn.candidates(TOP_K, corpus.count()), metric)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, true_label."""
    queries, _ = queries_and_corpus(spark, sf_dir)
    return queries.groupBy("query_id").agg(F.first("true_label").alias("true_label"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, scientific_name, common_name of the labels that embeddings have."""
    labels = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label")).distinct()
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("label"),
        F.concat_ws(" ", "p_type", "p_brand").alias("scientific_name"), F.col("p_name").alias("common_name"))
    return labels.join(part, "label", "left").select("label", F.coalesce("scientific_name", F.lit("")).alias("scientific_name"),
        F.coalesce("common_name", F.lit("")).alias("common_name"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' waveforms as recordings: item_id, label (one of seven), samples."""
    return signals(spark, sf_dir).select(F.col("user_id").cast("long").alias("item_id"),
        (F.col("user_id") % 7).cast("long").alias("label"), "samples")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values in time order, as a waveform: user_id, samples."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))),
        lambda x: x["value"].cast("double")).alias("samples"))
