"""Queries of the operators in this folder, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velotide.llm import (
    classifier,
    conversations,
    decontaminate,
    html,
    kneser_ney,
    licenses,
    line_runs,
    mixing,
    quality_rules,
    sharding,
    simhash,
    spelling,
    substring,
)
from velotide.llm.common import id_fold, read_table

SHARDS = 16
# Shares of bytes: the two named sources, and all others together.
WEIGHTS, REST, SEED = {"src0": 1.0, "src1": 1.0}, 8.0, "mix"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), WEIGHTS, REST, SEED)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.dedup_lines(read_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_fold("doc_id", 10) == 0
    scored = kneser_ney.fit_and_score(read_table(spark, sf_dir, "documents"), held)
    return scored.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), SHARDS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(read_table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.group_variants(read_table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.drop_shared_lines(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix, op2_line_dedup, op3_main_text, op4_kneser_ney, op5_simhash,
        op6_licenses, op7_decontaminate, op8_quality_rules, op9_shards, op10_quality,
        op11_repair, op12_spelling, op13_line_runs,
    )
}

ORACLES = {
    "op1_mix": mixing.mix_sql(WEIGHTS, REST, SEED),
    "op2_line_dedup": substring.DEDUP_SQL,
    "op8_quality_rules": quality_rules.RULES_SQL,
    "op11_repair": conversations.REPAIR_SQL,
    "op12_spelling": spelling.VARIANTS_SQL,
    "op13_line_runs": line_runs.DROP_SQL,
}
