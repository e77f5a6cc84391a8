"""The corpus pipeline: documents to training shards, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns all that it keeps; it is written as Parquet and read
again as the next stage's documents.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import decontam, mixing, neardup, quality, sharding
from seqloom.llm.common import NUMBER, cut, every, numbered, row_id, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).filter("__seqloom_kept").select(*every(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least doc_id of each near-duplicate class stays, and no other."""
    rows = numbered(docs)
    first = neardup.classes(rows.withColumn("doc_id", F.col(NUMBER))).filter("doc_id = class_id").select(F.col("doc_id").alias(NUMBER))
    return rows.join(first, NUMBER, "left_semi").select(*every(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    found = decontam.judged(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("__seqloom_id"), F.col("row").alias("__seqloom_row"))
    return docs.join(found, (row_id() == F.col("__seqloom_id")) & (decontam.text_print() == F.col("__seqloom_row")), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix takes, in training order."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shard and a slot for every row of the mix."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources), ("shard", shard)]

#: Learned rules, minhash classes and greedy packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
