"""A batch of requests in one plan: resolved sequences to design, selection and oligos.

Each distinct sequence is designed once and each (sequence, number wanted) selected once, however many requests
name them; requests meet the kept sets in merge joins, as both grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import assembly, designer, offtarget, resolution, selection


def intervals(sets: DataFrame) -> DataFrame:
    """``sets`` with the places of their probes, in order."""
    spans = [("start", "left_end"), *([("left_end", "middle_end")] if "middle_end" in sets.columns else []), ("right_start", "right_end")]
    return sets.withColumn("intervals", F.array(*[F.struct(F.col(a).alias("start"), F.col(b).alias("end")) for a, b in spans]))


def kept_oligos(resolved: DataFrame, probes: DataFrame, config: designer.Config = designer.DUAL, subjects: DataFrame | None = None, default: int = 5) -> DataFrame:
    """task, bp_id, locus, set_id and the oligos of the sets kept for each request.

    ``resolved``: task, bp_id, max_selected, locus, seq, of which requests without a sequence or with an unknown probe have
    no rows.  With ``subjects`` (subject_id, strand, seq) sets are ranked by their off-target score, else they
    stay in the order of design."""
    known = resolved.filter("seq is not null")
    plan = written(resolution.plan(known.drop("seq"), probes, default).select("task", "bp_id", "bridge", "locus", "max_selected"))
    genes = written(known.groupBy("locus").agg(F.min("seq").alias("seq")).withColumnRenamed("locus", "gene_id"))
    sides = [f"{p}_seq" for p in ("left", *["middle"] * (config.arity == 3), "right")]
    sets = written(designer.design(genes, config))
    if subjects is not None:
        tried = written(sets.select(F.explode(F.array(*sides)).alias("probe_seq")).distinct())
        sets = written(offtarget.rank(offtarget.set_scores(sets, offtarget.evidence(tried, offtarget.search(tried, subjects)), sides)))
    asked = plan.select(F.col("locus").alias("gene_id"), "max_selected").distinct()
    entered = intervals(sets).withColumn("score", F.col("set_id") - 1).join(asked.hint("merge"), "gene_id")
    kept = selection.select_sets(entered, F.col("max_selected"), keys=("gene_id", "max_selected")).filter("keep")
    chosen = kept.join(sets.hint("merge"), ["gene_id", "set_id"]).select(F.col("gene_id").alias("locus"), "max_selected", "set_id", *sides)
    base = assembly.free_base(F.col("task"))
    oligos = (assembly.triple_oligos if config.arity == 3 else assembly.dual_oligos)(plan.join(chosen.hint("merge"), ["locus", "max_selected"]), base)
    return oligos.select("task", "bp_id", "locus", "set_id", *[s.replace("_seq", "_oligo") for s in sides])
