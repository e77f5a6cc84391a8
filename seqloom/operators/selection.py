"""Selection of well-spaced probe sets per gene.

From every start a chain picks the next sets that keep the distance; of the chains with the wanted
number, the most even one wins, then the least score, then the earliest.  Without such a chain, sets are taken
greedily by score.  Sets that do not nest point to the next that keeps the distance, and chains are doubled along these
pointers, so a gene's sets are rows; only where sets lie in each other's gaps is a gene one fold.  Chains are small in a
file and large in memory, so their joins are asked to be merge joins: none is sent through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

MIN_DISTANCE = 15
# The annotations.
KEPT = "Selected for optimal coverage and specificity."
DROPPED = "Not selected due to lower specificity or suboptimal coverage."


def apart(a: Column, b: Column, distance: int = MIN_DISTANCE) -> Column:
    """Two intervals (start, end) keep the distance."""
    return (a["end"] < b["start"] - distance) | (b["end"] < a["start"] - distance)


def sets_too_close(a: Column, b: Column, distance: int = MIN_DISTANCE) -> Column:
    """Some interval of one set is too close to one of the other (arrays of intervals)."""
    return F.exists(a, lambda x: F.exists(b, lambda y: ~apart(x, y, distance)))


def coverage(spans: Column) -> Column:
    """Evenness of sorted spans (start, end): 1 / (1 + variance of the gaps about the ideal / 10000)."""
    n = F.size(spans)
    gaps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: (F.get(spans, i)["start"] - F.get(spans, i - 1)["end"]).cast("double"))
    ideal = (F.array_max(F.transform(spans, lambda s: s["end"])) - F.array_min(F.transform(spans, lambda s: s["start"]))) / (n - 1)
    variance = F.aggregate(gaps, F.lit(0.0), lambda a, g: a + (g - ideal) * (g - ideal)) / (n - 1)
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.lit(1.0)).otherwise(F.lit(1.0) / (F.lit(1.0) + variance / F.lit(10000.0)))


def coverage_by_key(spans: DataFrame, key: str) -> DataFrame:
    return spans.groupBy(key).agg(coverage(F.sort_array(F.collect_list(F.struct("start", "end")))).alias("coverage"))


def too_close_pairs(sets: DataFrame, distance: int = MIN_DISTANCE) -> DataFrame:
    """key, id, other (id < other) of sets that are too close: an equi-join on coarse position, as spans are short.
    ``sets``: gene_id, set_id, intervals."""
    cell = 128
    spans = sets.withColumn("low", F.array_min(F.transform("intervals", lambda x: x["start"])) - distance).withColumn("high", F.array_max(F.transform("intervals", lambda x: x["end"])) + distance)
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor(F.col("high") / cell))))
    left, right = cells.select("gene_id", "cell", "set_id", "intervals"), cells.select("gene_id", "cell", F.col("set_id").alias("other"), F.col("intervals").alias("other_intervals"))
    return left.join(right, ["gene_id", "cell"]).filter(F.col("set_id") < F.col("other")).filter(sets_too_close(F.col("intervals"), F.col("other_intervals"), distance)).select("gene_id", "set_id", "other").distinct()


def evidence_score(quality: Column, specificity: Column, junction: Column) -> Column:
    """Quality and specificity together, 5 more where the junction is G or C, which hinders ligation."""
    return quality + specificity + F.when(junction, 5).otherwise(0)


_ITEM = ["start", "set_id", "end", "score", "intervals"]


def _pointed(sets: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """``sets`` with ``i``, their place by start, and ``next``, the first place that keeps the distance to them."""
    placed = written(sets.withColumn("i", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "set_id"))))
    there = placed.select(*keys, F.col("start").cast("long").alias("at"), F.lit(0).alias("asks"), "i", F.col("i").alias("node"))
    asks = placed.select(*keys, (F.col("end") + distance + 1).cast("long").alias("at"), F.lit(1).alias("asks"), "i", F.lit(None).cast("int").alias("node"))
    behind = Window.partitionBy(*keys).orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = there.union(asks).withColumn("next", F.min("node").over(behind)).filter("asks = 1").select(*keys, "i", "next")
    return placed.join(seen.hint("merge"), [*keys, "i"])


def _best_chains(sets: DataFrame, wanted: Column, most: int, keys: Sequence[str], distance: int) -> DataFrame:
    """keys, chosen: the best of the full chains from all starts, where there is one.

    A set that starts behind the last taken one's end keeps the distance to all taken before, so a chain follows pointers; chains of
    one set are doubled until they are long enough."""
    chains = written(_pointed(sets, keys, distance).select(*keys, "i", "next", F.array(F.struct("start", "set_id", "end", "score")).alias("c")))
    length = 1
    while length < most:
        further = chains.select(*keys, F.col("i").alias("next"), F.col("next").alias("then"), F.col("c").alias("more"))
        chains = written(chains.join(further.hint("merge"), [*keys, "next"], "left").select(*keys, "i", F.col("then").alias("next"), F.when(F.col("more").isNull(), F.col("c")).otherwise(F.concat("c", "more")).alias("c")))
        length *= 2
    full = chains.withColumn("c", F.slice("c", F.lit(1), wanted)).filter(F.size("c") == wanted)
    ranked = F.struct(coverage(F.col("c")).alias("even"), (-F.aggregate("c", F.lit(0.0), lambda a, x: a + x["score"])).alias("score"), (-F.col("i")).alias("i"))
    return full.groupBy(*keys).agg(F.max_by("c", ranked).alias("c"))


def _tried_chains(sets: DataFrame, wanted: Column, keys: Sequence[str], distance: int) -> DataFrame:
    """The same for sets that lie inside each other's gaps: a fold from every start over a key's sets."""
    per = sets.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*_ITEM))).alias("s"))
    chains = F.transform(F.sequence(F.lit(1), F.size("s")), lambda i: _grown(F.slice("s", i, F.size("s")), per.schema["s"].dataType.simpleString(), wanted, distance))
    ranked = F.transform("full", lambda c, i: F.struct(coverage(c).alias("even"), (-F.aggregate(c, F.lit(0.0), lambda a, x: a + x["score"])).alias("score"), (-i).alias("i"), c.alias("c")))
    best = per.withColumn("full", F.filter(chains, lambda c: F.size(c) == wanted)).filter(F.size("full") > 0)
    return best.select(*keys, F.transform(F.array_max(ranked)["c"], lambda x: F.struct(*[x[c].alias(c) for c in _ITEM[:-1]])).alias("c"))


def _grown(items: Column, kind: str, wanted: Column, distance: int) -> Column:
    """The items taken one after the other, each at a distance to all taken before, up to ``wanted``."""
    clear = lambda taken, x: ~F.exists(taken, lambda t: sets_too_close(t["intervals"], x["intervals"], distance))
    grow = lambda taken, x: F.when((F.size(taken) < wanted) & clear(taken, x), F.array_append(taken, x)).otherwise(taken)
    return F.aggregate(items, F.array().cast(kind), grow)


def select_sets(sets: DataFrame, wanted: int | Column = 5, distance: int = MIN_DISTANCE, keys: Sequence[str] = ("gene_id",)) -> DataFrame:
    """The ``keys``, set_id, keep, reason. ``sets``: keys, set_id, score, intervals (sorted array of start, end);
    ``wanted`` may be one of the keys, so that each request has its own number."""
    wanted = F.lit(wanted) if isinstance(wanted, int) else wanted
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(F.size("intervals") - 1, F.lit(1))), lambda i: F.get("intervals", i)["start"] - F.get("intervals", i - 1)["end"])
    base = written(sets.select(*keys, "set_id", F.col("score").cast("double").alias("score"), "intervals", F.array_min(F.transform("intervals", lambda x: x["start"])).alias("start"), F.array_max(F.transform("intervals", lambda x: x["end"])).alias("end"), F.coalesce(F.array_max(gaps), F.lit(0)).alias("gap"), wanted.alias("_wanted")))
    most = base.agg(F.max("_wanted")).first()[0] or 1
    # a set fits into another's gap only where that leaves the distance on both sides
    wide = base.groupBy(*keys).agg(F.max("gap").alias("gap")).filter(F.col("gap") > 2 * distance + 1).select(*keys)
    nested = not wide.isEmpty()
    chosen = _best_chains(base.join(wide.hint("merge"), list(keys), "left_anti") if nested else base, wanted, most, keys, distance)
    if nested:
        chosen = chosen.unionByName(_tried_chains(base.join(wide.hint("merge"), list(keys), "left_semi"), wanted, keys, distance))
    chosen = written(chosen)
    # by score where no chain is full; a fold over the sets of such a key
    rest = base.join(chosen.hint("merge"), list(keys), "left_anti").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("score", "start", "set_id", "end", "intervals"))).alias("s"))
    greedy = rest.select(*keys, F.transform(_grown(F.col("s"), rest.schema["s"].dataType.simpleString(), wanted, distance), lambda x: F.struct(*[x[c].alias(c) for c in _ITEM[:-1]])).alias("c"))
    listed = chosen.unionByName(greedy).select(*keys, F.posexplode("c").alias("at", "x")).select(*keys, "at", "x.set_id")
    taken = listed.join(base.select(*keys, "set_id", "intervals").hint("merge"), [*keys, "set_id"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", "set_id", "intervals"))).alias("chosen"))
    out = base.join(taken.hint("merge"), list(keys))
    blocking = F.filter("chosen", lambda t: sets_too_close(t["intervals"], F.col("intervals"), distance))
    keep = F.exists("chosen", lambda t: t["set_id"] == F.col("set_id"))
    reason = F.when(keep, KEPT).when(F.size(blocking) > 0, F.format_string("Too close to selected set %d.", F.get(blocking, F.lit(0))["set_id"])).otherwise(DROPPED)
    return out.select(*keys, "set_id", keep.alias("keep"), reason.alias("reason"))


def kept_counts(selected: DataFrame) -> DataFrame:
    return selected.groupBy("gene_id").agg(F.sum(F.col("keep").cast("int")).alias("kept"), F.sum((~F.col("keep")).cast("int")).alias("dropped"))
