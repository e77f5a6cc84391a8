"""Random pools and the screen: the first failing test of each sequence, and how many fail where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import gc_fraction, has_hairpin_ends, has_poly_n
from ..functions.thermo import NN3, tm, tm_between

STAGES = ("gc", "poly_n", "tm", "hairpin", "valid")


def random_sequences(spark: SparkSession, n: int, length: int = 25, seed: int = 0) -> DataFrame:
    """seq: n sequences from a hash of (seed, number) - the same on every run and on any cluster."""
    digits = F.concat(*[F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"), F.lit(str(i)))) for i in range((length + 31) // 32)])
    return spark.range(n).select(F.substring(F.translate(digits, "0123456789abcdef", "ACGTACGTACGTACGT"), 1, length).alias("seq"))


def failing_stage(s: Column | str, min_gc: float = 0.4, max_gc: float = 0.6, poly_n: int = 4, min_tm: float = 53.0, max_tm: float = 56.0, hairpin: int = 4, matches: int = 3) -> Column:
    """``when`` short-circuits, so the temperature is computed behind the cheap tests alone."""
    return F.when(~gc_fraction(s).between(min_gc, max_gc), "gc").when(has_poly_n(s, poly_n), "poly_n").when(~tm_between(s, min_tm, max_tm, NN3), "tm").when(has_hairpin_ends(s, hairpin, matches), "hairpin").otherwise("valid")


def screen(sequences: DataFrame, **limits) -> DataFrame:
    return sequences.withColumn("stage", failing_stage("seq", **limits))


def stage_counts(screened: DataFrame) -> DataFrame:
    return screened.groupBy("stage").agg(F.count("*").alias("n"))


def generate(spark: SparkSession, wanted: int, length: int = 25, existing: DataFrame | None = None, seed: int = 0, factor: int = 1000, **limits) -> DataFrame:
    """seq, tm, gc: existing sequences of the length that pass, then random ones up to ``wanted`` (a limit by design)."""
    held = existing.filter(F.length("seq") == length).select("seq", F.lit(0).alias("part")) if existing is not None else None
    pool = random_sequences(spark, wanted * factor, length, seed).select("seq", F.lit(1).alias("part"))
    rows = screen(pool if held is None else held.union(pool), **limits).filter("stage = 'valid'")
    return rows.select("seq", F.round(tm("seq", NN3), 2).alias("tm"), F.round(gc_fraction("seq"), 2).alias("gc"), "part").orderBy("part", "seq").limit(wanted).drop("part")
