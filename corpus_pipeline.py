"""Five stages that turn raw documents into sampled token sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; docs has the columns of documents. run() writes every stage's result as
Parquet in the shared folder and reads it again, so a lost executor costs one
stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import decontaminate, jaccard, linededup, pieces, quality
from corpuslens.llm.common import WORD, Store, sized

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents that score lower are rejected.
LEAST_QUALITY = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; trees are learnt outside the held-out part.

    Null and empty texts are scored like others, repeated rows each; without
    labels every score is 0.5 and all stay. An empty table stays empty.
    """
    trees = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, trees).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those left without a word go.

    Null texts and rows without doc_id stay as they are. Rows that repeat a doc_id
    are documents of their own, rows equal in text too keep the same.
    """
    out = linededup.dedup(docs.select(*COLUMNS)).where(F.col("n_deleted").isNull() | (F.col("n_deleted") == 0) | F.rlike("text", F.lit(WORD)))
    return out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingle sets of similarity 0.8 or more.

    Of rows that repeat a doc_id the least in all columns stays; rows without doc_id all stay.
    """
    store = Store(spark)
    linked = jaccard.linked(docs.select("doc_id", "text"), k=5, pct=80)
    gone = store.put(linked.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    rows = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    out = docs.select(*COLUMNS).join(sized(gone, gone.count()), "doc_id", "left_anti")
    if not rows:
        return out
    one = out.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return one.unionByName(out.where("doc_id is null"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Null and empty texts contain none and stay, as do rows without doc_id; of a
    doc_id that repeats all rows go if their texts together contain an item.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document: doc_id, sample, ids, log_prob, log_inclusion, exact.

    A null or empty text has one, without ids; repeated rows have the same ones.
    """
    # The executors' heaps are grown by the stages before; small slices leave them room.
    return pieces.sample(docs, k=2, cache=400_000, slice_bytes=1 << 19)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", token_stage),
]

#: Learnt trees and sampled token sequences have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over all documents."""
    store = Store(spark)
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), None
    for name, stage in STAGES:
        docs, before = store.put(stage(spark, docs, sf_dir), name), last
        if before is not None:
            store.drop(before)
        last = docs
    return docs
