"""Mixing sources to target weights as a time-varying curriculum (DataFrame functions only).

Every source has a weight schedule over the run, one rate per phase of equal
length.  Its integral times the source's target is the source's cumulative
token demand; inverting it at the middle of a document copy gives the training
position of that copy.  Positions interleave the sources, and a range sort by
position deals the training order over partitions.

Documents of a source form one stream in the order of ``md5(doc_id)``, repeated
epoch after epoch; a copy is taken when its middle lies below the target, so a
source misses its target by half a document at most.  Offsets come from bucket
sums plus a running sum inside (source, bucket), so no source, however large,
meets in one task.

Edge cases: a null or wordless text has size 0 and takes nothing; a null source
is a source of its own, sorted last; a null doc_id keeps its row; repeated rows
are streamed one after the other, equal ones in any order; no rows give no rows; other columns of the
input are ignored, whatever their names.

The table of sources, one row each, is sorted whole in one task: it is meant for up to a million sources or so.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NUMBER, cut, every, numbered, words

#: Weights and phase rates by source rank, repeating.
WEIGHTS = (5, 2, 1)
SCHEDULES = ((4, 3, 2, 1), (1, 2, 3, 4), (1, 1, 1, 1))
#: Hex digits of md5 that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[int]] = SCHEDULES, cap: int = 3, share: int = 100) -> DataFrame:
    """One row per source: source_size, weight, rates, target.

    Targets are ``min(cap * source_size, level * weight)`` with the one level at
    which they add up to ``share`` percent of all sizes - where resharing the
    excess by weight ends.  The table has one row per source, and is sorted whole.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = per.select("*", rank.alias("rank"))
    pick = lambda values: F.element_at(F.array(*values), (F.col("rank") % len(values) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "rank", pick([F.lit(int(w)) for w in weights]).alias("weight"), pick([F.array(*[F.lit(float(r)) for r in s]) for s in schedules]).alias("rates"))
    ratio = (F.col("source_size") * cap / F.col("weight")).alias("ratio")
    by_ratio = Window.orderBy("ratio", "rank")
    everywhere = Window.partitionBy()
    filled = (
        ranked.select("*", ratio)
        .select(
            "*",
            (F.sum("source_size").over(everywhere) * share / 100).alias("total"),
            F.coalesce(F.sum(F.col("source_size") * cap).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_before"),
            F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("weight_from"),
        )
        .withColumn("full", F.col("ratio") * F.col("weight_from") <= F.col("total") - F.col("full_before"))
        .withColumn("level", (F.col("total") - F.sum(F.when(F.col("full"), F.col("source_size") * cap).otherwise(0)).over(everywhere)) / F.sum(F.when(~F.col("full"), F.col("weight")).otherwise(0)).over(everywhere))
    )
    target = F.when(F.col("full"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("level") * F.col("weight"))
    return filled.select("source", "source_size", "weight", "rates", target.alias("target"))


def invert_demand(fraction: Column, rates: Column) -> Column:
    """Time in 0..1 at which the integral of ``rates`` reaches ``fraction`` of its whole."""
    total = F.aggregate(rates, F.lit(0.0), lambda a, r: a + r)
    start = F.struct((fraction * total).alias("left"), F.lit(0.0).alias("t"))

    def spend(state, rate):
        here = F.least(F.greatest(state["left"], F.lit(0.0)), rate)
        return F.struct((state["left"] - rate).alias("left"), (state["t"] + F.when(rate > 0, here / rate).otherwise(0.0)).alias("t"))

    return F.aggregate(rates, start, spend, lambda s: s["t"]) / F.size(rates)


def _placed(docs: DataFrame, carried: Sequence[str], weights: Sequence[int], schedules: Sequence[Sequence[int]], cap: int, share: int) -> DataFrame:
    """Of each row: doc_id, source, size, source_size, target, n_copies, taken, positions and the ``carried`` columns.
    Texts are read for their sizes alone and do not travel."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text))))
    sized = cut(docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"), F.xxhash64(text).alias("print"), *carried)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    sums = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    targets = source_targets(sums, weights, schedules, cap, share)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "print").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
        .withColumn("at", F.col("inner") + F.col("offset"))
        .join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source")))
    )
    # epochs e with 2 * (e * source_size + at) + size < 2 * target
    room = (2 * F.col("target") - F.col("size") - 2 * F.col("at")) / (2 * F.col("source_size"))
    copies = F.when(F.col("size") > 0, F.least(F.greatest(F.ceil(room), F.lit(0)), F.lit(cap))).otherwise(0).cast("long")
    middle = lambda e: (e * F.col("source_size") + F.col("at") + F.col("size") / 2) / F.col("target")
    positions = F.when(F.col("n_copies") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_copies") - 1), lambda e: invert_demand(middle(e), F.col("rates")))).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("n_copies", copies).select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("n_copies") * F.col("size")).alias("taken"), positions.alias("positions"), *carried)


def assign(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[int]] = SCHEDULES, cap: int = 3, share: int = 100) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, n_copies, taken and positions
    (training position of each copy, in 0..1)."""
    return _placed(docs, [], weights, schedules, cap, share)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[int]] = SCHEDULES, cap: int = 3, share: int = 100) -> DataFrame:
    """The mixed corpus: one row per taken copy with all columns of ``docs``, range-sorted by
    training position.  Rows meet their positions by a number of their own, so each row is taken as :func:`assign`
    says, also where several share a doc_id."""
    rows = numbered(docs)
    taken = _placed(rows, [NUMBER], weights, schedules, cap, share).filter("n_copies > 0").select(NUMBER, F.col("positions").alias("__seqloom_positions"))
    copies = rows.join(taken, NUMBER).select(*every(docs), F.explode("__seqloom_positions").alias("__seqloom_position"))
    return copies.repartitionByRange("__seqloom_position", "doc_id").sortWithinPartitions("__seqloom_position", "doc_id").drop("__seqloom_position")
