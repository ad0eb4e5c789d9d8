"""A corpus pipeline: each stage reads what the one before it has written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelflow.llm import toxicity
from kestrelflow.llm.common import shared_dir
from kestrelflow.llm.decontam import drop_contaminated
from kestrelflow.llm.lines import drop_boilerplate
from kestrelflow.llm.mixing import mix_sources
from kestrelflow.llm.neardup import near_duplicates


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled ones among them, scores 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than 5 % of a source's documents go; n_chars follows the text, no document goes.

    Copies and near-duplicates, as the next stage finds them, count as one document here, so that one
    whole text of each group reaches it.
    """
    out = drop_boilerplate(docs, host="source", percent=5, least_pages=3, near=(5, 80))
    out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id.

    Rows without an id stay. Rows of one id are documents of their own where their texts differ; of
    rows with one id and one text, one stays.
    """
    names = docs.columns
    rows = docs.withColumns({"_key": F.xxhash64("doc_id", "text"), "_also": F.xxhash64(F.lit(1), "text", "doc_id")})
    rows = rows.where("doc_id is not null")
    found = near_duplicates(rows.select(F.col("_key").alias("doc_id"), "text"), shingle=5, percent=80)
    found = found.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    ids = rows.select("_key", "doc_id").distinct().join(found, "_key")
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_key")).select("_key")
    stay = rows.join(kept, "_key", "left_semi").dropDuplicates(["_key", "_also"]).select(*names)
    return docs.where("doc_id is null").unionByName(stay)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its position in the mix; sources weigh as the square roots of their sizes."""
    return mix_sources(docs, bounded=False)


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("mixing", source_mixing),
]

#: The stages fit a model and search for neighbours, which SQL cannot express; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}-{name}")
        docs = spark.read.parquet(f"{place}/{k}-{name}")
    return docs
