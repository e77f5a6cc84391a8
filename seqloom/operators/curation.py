"""FASTA curation: types, invalid characters, variants, formatting with its counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import base_gene_id, header_id, invalid_characters, sequence_type
from ..sources.scratch import numbered, written


def longest_variant(records: DataFrame) -> DataFrame:
    """base_id, id, seq: the longest sequence of each base id, the first in file order on ties.
    Map-side maxima, one small shuffle row for each base id and task."""
    best = F.min_by(F.struct("id", "seq"), F.struct(-F.length("seq"), F.col("ord")))
    return records.groupBy(base_gene_id("id").alias("base_id")).agg(best.alias("b")).select("base_id", "b.id", "b.seq")


def shortest_isoform(records: DataFrame) -> DataFrame:
    """gene, seq: the shortest sequence of the id up to its first dot, the first on ties."""
    return records.groupBy(F.substring_index("id", ".", 1).alias("gene")).agg(F.min_by("seq", F.struct(F.length("seq"), F.col("ord"))).alias("seq"))


def removed_variants(records: DataFrame) -> DataFrame:
    """id, base_id of the variants that give way to a longer one."""
    rank = F.row_number().over(Window.partitionBy("base_id").orderBy(F.desc(F.length("seq")), "ord"))
    return records.select("id", base_gene_id("id").alias("base_id"), "seq", "ord").withColumn("r", rank).filter("r > 1").select("id", "base_id")


def drop_after_invalid(records: DataFrame) -> DataFrame:
    """The compatibility rule: a record right after an invalid one that was itself read is dropped unseen.

    Within a run of records that follow invalid ones, drops alternate, so the parity of the place in the
    run decides.  Places are numbered range by range; the last start of a run before a range comes from the table of
    ranges, so no task reads all records."""
    rows = written(numbered(records.select("ord", "invalid"), "ord", "n"))
    after = rows.filter("invalid").select((F.col("n") + 1).alias("n"), F.lit(True).alias("after"))
    placed = rows.join(after, "n", "left").withColumn("start", F.when(F.col("after").isNull(), F.col("n")))
    ranges = placed.groupBy("part").agg(F.max("start").alias("last"))
    carried = ranges.select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.max("start").over(Window.partitionBy("part").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    dropped = placed.withColumn("inside", inside).join(carried, "part").filter((F.col("n") - F.greatest("inside", "carried")) % 2 == 1)
    return records.join(dropped.select("ord"), "ord", "left_anti")


def checked(records: DataFrame, clean_headers: bool = True, uppercase: bool = True) -> DataFrame:
    """header, seq, ord -> id, seq, ord, kind, bad (characters), invalid."""
    seq = F.upper("seq") if uppercase else F.col("seq")
    named = records.select((header_id("header") if clean_headers else F.col("header")).alias("id"), seq.alias("seq"), "ord")
    typed = named.withColumn("kind", sequence_type("seq"))
    return typed.withColumn("bad", invalid_characters("seq", "kind")).withColumn("invalid", F.col("bad") != "")


def format_records(records: DataFrame, filter_invalid: bool = True, deduplicate: bool = True, compat_drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """The formatted records (id, seq, ord) and one row of counts: total, invalid, kept, removed, kind.

    Of equal ids the last sequence wins at the first one's place; then, if asked for, the longest of a base id's at the place where
    the base id is first met.  ord orders them so.  kind is that of most records, invalid ones too."""
    rows = checked(records).filter(F.length("seq") > 0)
    rows = drop_after_invalid(rows) if compat_drop else rows
    valid = rows.filter("not invalid") if filter_invalid else rows
    named = valid.groupBy("id").agg(F.max_by("seq", "ord").alias("seq"), F.min("ord").alias("ord"))
    kept = named
    if deduplicate:
        best = F.min_by("seq", F.struct(-F.length("seq"), F.col("ord")))
        kept = named.groupBy(base_gene_id("id").alias("id")).agg(best.alias("seq"), F.min("ord").alias("ord"))
    tally = rows.agg(F.count("*").alias("total"), F.sum(F.col("invalid").cast("int")).alias("invalid"), F.sum((F.col("kind") == "NT").cast("int")).alias("nt"), F.sum((F.col("kind") == "AA").cast("int")).alias("aa"))
    kind = F.when(F.col("nt") > F.col("aa"), "NT").when(F.col("aa") > F.col("nt"), "AA").otherwise("Mixed")
    # one row each
    sizes = tally.join(F.broadcast(kept.agg(F.count("*").alias("kept")))).join(F.broadcast(named.agg(F.count("*").alias("ids"))))
    return kept, sizes.select("total", "invalid", "kept", (F.col("ids") - F.col("kept")).alias("removed"), kind.alias("kind"))
