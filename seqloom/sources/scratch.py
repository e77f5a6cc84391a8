"""Written tables that cut long lineages, in the folder the session shares with its executors."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` from a table in the scratch folder; the shuffles behind the table give their disk back."""
    spark, drop = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = scratch_dir(spark), spark.conf.get(drop, "false")
    spark.conf.set(drop, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(drop, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal few, long sequences over all cores before they are exploded: a row becomes thousands of windows, so
    moving the rows is cheap next to what they become.  Inputs with enough partitions stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def numbered(df: DataFrame, by: str, name: str) -> DataFrame:
    """``df``, written in the order of ``by``, with ``name`` (its place, from 1) and ``part``, the range it lies in.

    Ranges are numbered each for itself behind the rows before it; the table of ranges alone, one row each, is
    summed in one task."""
    dealt = written(df.repartitionByRange(by).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(by))
    return dealt.withColumn("_place", place).join(offsets, "part").withColumn(name, F.col("offset") + F.col("_place")).drop("offset", "_place")
