"""Resolving gene names to sequences, and batches of requests.

Each distinct locus is resolved once.  Libraries hold whole sequences and grow with the requests, and the planner takes a
derived sequence for 20 bytes, so joins with them are asked to be merge joins: nothing of them goes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import numbered, written


def to_locus(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """``requests`` (gene_id) with ``locus``: upper-cased, and its alias's locus if it is one."""
    known = aliases.select(F.upper("symbol").alias("_symbol"), F.upper("locus").alias("_locus"))
    return requests.join(known, F.upper("gene_id") == F.col("_symbol"), "left").withColumn("locus", F.coalesce("_locus", F.upper("gene_id"))).drop("_symbol", "_locus")


def exact(requests: DataFrame, *libraries: DataFrame) -> DataFrame:
    """``requests`` (locus) with ``seq`` and ``source`` (1, 2, ...): the first library that has the id."""
    out = requests
    for i, lib in enumerate(libraries):
        out = out.join(lib.select(F.col("id").alias("locus"), F.col("seq").alias(f"_s{i}")).hint("merge"), "locus", "left")
    found = [f"_s{i}" for i in range(len(libraries))]
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), i + 1) for i, c in enumerate(found)])
    return out.withColumn("seq", F.coalesce(*found)).withColumn("source", source).drop(*found)


def fuzzy(requests: DataFrame, reference: DataFrame) -> DataFrame:
    """locus, ref_id, seq: for requests without an exact hit, the first reference id that contains the locus.

    The pieces of an id that are as long as some name are its keys, so a name of any length meets the ids that contain it in
    an equi-join, and nothing else."""
    names = requests.filter("seq is null and locus is not null").select("locus").distinct()
    lengths = [r[0] for r in names.select(F.length("locus")).distinct().collect()]  # no more than an id has letters, or they match none
    size = F.length("id")
    pieces = lambda n: F.when(size >= n, F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("id"), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    keys = F.array_distinct(F.flatten(F.array(*[pieces(n) for n in sorted(lengths)]))) if lengths else F.array().cast("array<string>")
    index = reference.select(F.col("id").alias("ref_id"), "ord", F.explode(keys).alias("locus"))
    first = index.hint("merge").join(names, "locus").groupBy("locus").agg(F.min_by("ref_id", F.struct("ord", "ref_id")).alias("ref_id"), F.min("ord").alias("ord"))
    return first.join(reference.select(F.col("id").alias("ref_id"), "seq", "ord").hint("merge"), ["ref_id", "ord"]).select("locus", "ref_id", "seq")


def resolve(requests: DataFrame, aliases: DataFrame, coding: DataFrame, transcript: DataFrame, reference: DataFrame) -> DataFrame:
    """``requests`` with locus, seq and source (1 coding, 2 transcript, 3 reference, 4 fuzzy)."""
    located = to_locus(requests, aliases)
    first = written(exact(located.filter("locus is not null").select("locus").distinct(), coding, transcript, reference))
    loose = fuzzy(first, reference).select("locus", F.col("seq").alias("_seq"))
    found = first.join(loose, "locus", "left").withColumn("source", F.coalesce("source", F.when(F.col("_seq").isNotNull(), 4))).withColumn("seq", F.coalesce("seq", "_seq")).drop("_seq")
    return located.join(written(found).hint("merge"), "locus", "left")


def plan(requests: DataFrame, probes: DataFrame, default: int = 5) -> DataFrame:
    """task, bp_id, bridge, locus, max_selected: requests whose probe is known; an unreadable limit is the default."""
    limit = F.coalesce(F.expr("try_cast(max_selected AS INT)"), F.lit(default))
    return requests.withColumn("max_selected", limit).join(probes.select("bp_id", F.col("seq").alias("bridge")).hint("merge"), "bp_id")


def number_genes(genes: DataFrame) -> DataFrame:
    """gene_id, bp_id: genes in order get BP_1001, BP_1002, ..."""
    return numbered(genes.select("gene_id"), "gene_id", "n").select("gene_id", F.format_string("BP_%04d", F.col("n") + 1000).alias("bp_id"))
