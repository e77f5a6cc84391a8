"""Expression: transcripts per million and the probe count it suggests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import probe_count


def tpm(counts: DataFrame, lengths: DataFrame, key: str = "gene_id") -> DataFrame:
    """key, tpm for ids in both tables; nothing when all rates are zero. The total is one aggregate row, broadcast."""
    rates = counts.join(lengths, key).select(key, (F.col("count") / (F.col("length") / F.lit(1000.0))).alias("rpk"))
    total = rates.agg(F.sum("rpk").alias("total")).filter("total <> 0")
    return rates.join(F.broadcast(total)).select(key, (F.col("rpk") * F.lit(1e6) / F.col("total")).alias("tpm"))


def recommend(tpms: DataFrame, key: str = "gene_id") -> DataFrame:
    return tpms.select(key, F.round("tpm", 2).alias("tpm")).withColumn("n_probes", probe_count("tpm"))
