"""From raw documents to token ids, in stages that each work on all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each as Parquet in the folder that executors share,
and reads it again, so that an executor that is lost costs its own tasks only. All but the last return the columns of documents;
other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard_join, language, suffix_dedup
from tessera.llm.shared import discard, scratch, stored, work_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` but those of ``gone`` (doc_id and a hash of the text). Written and counted first: up to ``BROADCAST_ROWS`` of them go to
    the texts, whatever size the session broadcasts by itself; more of them meet the texts by sorting, which moves each text once."""
    gone = stored(gone.toDF("_id", "_hash").distinct(), "gone")
    gone = gone.hint("broadcast" if gone.count() <= jaccard_join.BROADCAST_ROWS else "merge")
    key = docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"])
    return docs.join(gone, key, "left_anti").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text, declaration and source agree on a language; those that are none go."""
    hashed = docs.select(*COLUMNS).withColumn("_hash", F.xxhash64("text"))
    found = language.identify_documents(hashed, language.train(docs), keep=["doc_id", "_hash"])
    return _without(docs, found.where(~F.col("accepted")).select("doc_id", "_hash"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of the least id; of its repeated rows, one. Rows of one id, or of null ids, are told
    apart by their texts."""
    groups = jaccard_join.jaccard_groups(docs, hashed=True)
    kept = _without(docs, groups.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select("doc_id", "text_hash"))
    again = stored(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("_id")), "again")
    if again.isEmpty():
        return kept
    twice = kept["doc_id"].eqNullSafe(again["_id"])  # few rows, or a join by sorting: the planner sees their size
    return kept.join(again, twice, "left_anti").unionByName(kept.join(again, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def _with_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text", F.col("cleaned")).withColumn("n_chars", F.char_length("cleaned").cast("long")).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated strings leave the texts; the first stays."""
    return _with_text(suffix_dedup.dedup(docs, keep="first", columns=["doc_id", "lang", "source"]))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences of benchmark windows leave the texts."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.decontaminate(docs, benchmark, keep=["doc_id", "lang", "source"]))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    return bpe.tokenise(docs, ["doc_id", "lang", "source"])


STAGES = [
    ("language", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's intermediate tables go when its result is written, and that one when the next is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"pipeline-{name}")
        with scratch():
            result = stage(spark, docs, sf_dir)
            result.write.parquet(path)
        if before is not None:
            discard({before})
        docs, before = spark.read.schema(result.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
