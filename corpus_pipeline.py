"""From raw documents to shards: classify, deduplicate, decontaminate, mix, shard.

Every stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet in the
shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from velotide.llm import classifier, decontaminate, mixing, near_copies, sharding
from velotide.llm.common import read_table, stage
from velotide.llm.queries import REST, SEED, SHARDS, WEIGHTS


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_good(docs, read_table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs, WEIGHTS, REST, SEED)
    return mixed.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs, SHARDS)


STAGES = [
    ("quality_classifier", classify),
    ("near_duplicates", deduplicate),
    ("decontamination", remove_benchmarks),
    ("mixing", mix),
    ("sharding", shard),
]

# A fitted network and similarities of shingles are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
