"""Assembly of the final oligos, and metrics of probe sets: projections, and windows for two-armed probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import complement, gc_percent, once, poly_n_ok, reverse_complement
from ..functions.thermo import NN3, tm, tm_between
from ..sources.scratch import spread, written
from .designer import disjoint_intervals
from .kmers import BLOCK, blocks

# Linkers, fluorophore oligos (oligo, suffix) and initiators (up spacer, down spacer, up, down).
ANCHOR, DUAL_TAIL, DUAL_HEAD = "TCTCGTTTTCTGAACTTAGC", "CGGTATCAAG", "CTGTTTAAGA"
TRIPLE_LEFT_TAIL, TRIPLE_MIDDLE_HEAD, TRIPLE_RIGHT_TAIL = "AAGATA", "ACATTA", "TAATGTTATCTT"
FLUOROPHORES = {"AF488": ("TCGCGCTTGGTATAATCGCT", "P1"), "Cy3": ("AGTAGCCGTGACTATCGACT", "P2"), "Texas": ("TGCGTCTATTTAGTGGAGCC", "P3"), "Cy5": ("CCTCAATGCTGCTGCTGTACTAC", "P4")}
INITIATORS = {
    "B1": ("aa", "ta", "GAGGAGGGCAGCAAACGG", "GAAGAGTCTTCCTTTACG"),
    "B2": ("aa", "aa", "CCTCGTAAATCCTCATCA", "ATCATCCAGTAAACCGCC"),
    "B3": ("tt", "tt", "GTCCCTGCCTCTATATCT", "CCACTCAACTTTAACCCG"),
    "B4": ("aa", "at", "CCTCAACCTACCTCCAAC", "TCTCACCATATTCGCTTC"),
    "B5": ("aa", "aa", "CTCACTCCCAATCTCTAT", "CTACCCTACAAATCCAAT"),
    "B7": ("ww", "ww", "CTTCAACCTCCACCTACC", "TCCAATCCCTACCCTCAC"),
    "B9": ("ww", "ww", "CACGTATCTACTCCACTC", "TCAGCACACTCCCAACCC"),
    "B10": ("ww", "ww", "CCTCAAGATACTCCTCTA", "CCTACTCGACTACCCTAG"),
    "B11": ("ww", "ww", "CGCTTAGATATCACTCCT", "ACGTCGACCACACTCATC"),
    "B13": ("ww", "ww", "AGGTAACGCCTTCCTGCT", "TTATGCTCAACATACAAC"),
    "B14": ("ww", "ww", "AATGTCAATAGCGAGCGA", "CCCTATATTTCTGCACAG"),
    "B15": ("ww", "ww", "CAGATTAACACACCACAA", "GGTATCTCGAACACTCTC"),
    "B17": ("ww", "ww", "CGATTGTTTGTTGTGGAC", "GCATGCTAATCGGATGAG"),
}


def initiators(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in INITIATORS.items()], "initiator string, up_spacer string, down_spacer string, up string, down string")


def bridge_arm(bridge: Column) -> Column:
    """17 bases and the complement, not reversed, of the last two; null unless the bridge has 19."""
    return F.when(F.length(bridge) == 19, F.concat(F.substring(bridge, 1, 17), complement(F.substring(bridge, 18, 2))))


def dual_oligos(sets: DataFrame, base: Column, anchor: str = ANCHOR) -> DataFrame:
    """``sets`` (left_seq, right_seq, bridge) with left_oligo and right_oligo; ``base`` fills the free position."""
    return sets.withColumn("left_oligo", F.concat("left_seq", F.lit(anchor), F.lit(DUAL_TAIL))).withColumn("right_oligo", F.concat(F.lit(DUAL_HEAD), base, bridge_arm(F.col("bridge")), F.col("right_seq")))


def triple_oligos(sets: DataFrame, base: Column) -> DataFrame:
    return (
        sets.withColumn("left_oligo", F.concat(F.col("left_seq"), base, bridge_arm(F.col("bridge")), F.lit(TRIPLE_LEFT_TAIL)))
        .withColumn("middle_oligo", F.concat(F.lit(TRIPLE_MIDDLE_HEAD), "middle_seq"))
        .withColumn("right_oligo", F.concat("right_seq", F.lit(TRIPLE_RIGHT_TAIL)))
    )


def free_base(task: Column) -> Column:
    """One base for each task, from its hash: the same on every run."""
    return F.substring(F.lit("ACGT"), (F.conv(F.substring(F.md5(task), 1, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))


def arm_windows(genes: DataFrame, size: int, arm: int, gc: tuple[float, float], heat: tuple[float, float], poly: int) -> DataFrame:
    """gene_id, start, w, number: most windows of ``size`` bases that do not touch and whose two arms pass."""
    cut = spread(blocks(genes, size, "gene_id", least=size), "gene_id", "offset")
    last = F.least(F.octet_length("b") - size, F.lit(BLOCK - 1))
    at = cut.select("gene_id", "offset", "b", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    at = at.select("gene_id", (F.col("offset") + F.col("at")).alias("start"), once(F.substring("b", F.col("at") + 1, F.lit(size)).cast("string"), "w"))
    at = at.select("*", once(F.substring("w", F.lit(1), F.lit(arm)), "first")).select("*", once(F.right("w", F.lit(arm)), "second"))
    for p in ("first", "second"):
        at = at.filter(gc_percent(p).between(*gc) & poly_n_ok(p, poly))
    for p in ("first", "second"):
        at = at.filter(tm_between(p, *heat, NN3))
    at = written(at.select("gene_id", "start", "w"))
    picked = disjoint_intervals(at.select("gene_id", "start", (F.col("start") + size).alias("end")), "gene_id")
    number = F.row_number().over(Window.partitionBy("gene_id").orderBy("start"))
    return at.join(picked.select("gene_id", "start"), ["gene_id", "start"], "left_semi").withColumn("number", number)


def hcr_oligos(windows: DataFrame, kit: DataFrame, arm: int = 25) -> DataFrame:
    """gene_id, probe_pos (from 1), names, oligos and temperatures. ``windows``: gene_id, start, w, number (from 1)."""
    p1, p2 = reverse_complement(F.substring("w", F.lit(1), F.lit(arm))), reverse_complement(F.right("w", F.lit(arm)))
    name = lambda i: F.concat(F.col("gene_id").cast("string"), F.lit("-"), F.replace("initiator", F.lit("B"), F.lit("I")), F.lit("-"), (F.col("number") * 2 - 1 + i).cast("string"))
    joined = windows.join(F.broadcast(kit)) if "initiator" not in windows.columns else windows.join(F.broadcast(kit), "initiator")
    return joined.select("gene_id", (F.col("start") + 1).alias("probe_pos"), name(0).alias("p1_name"), F.concat("up", "up_spacer", p1).alias("p1"), F.round(tm(p1, NN3), 4).alias("p1_tm"), name(1).alias("p2_name"), F.concat(p2, "down_spacer", "down").alias("p2"), F.round(tm(p2, NN3), 4).alias("p2_tm"))


def snail_oligos(windows: DataFrame, fluorophore: str = "AF488", arm: int = 20) -> DataFrame:
    oligo, suffix = FLUOROPHORES[fluorophore]
    p5, p3 = reverse_complement(F.substring("w", F.lit(1), F.lit(arm))), reverse_complement(F.right("w", F.lit(arm)))
    name = lambda end: F.concat(F.col("gene_id").cast("string"), F.lit("-"), F.col("number").cast("string"), F.lit(f"-{end}{suffix}"))
    return windows.select("gene_id", (F.col("start") + 1).alias("probe_pos"), name(5).alias("p5_name"), F.concat(F.lit(TRIPLE_MIDDLE_HEAD), p5, F.lit(oligo), F.lit(TRIPLE_LEFT_TAIL)).alias("p5"), F.round(tm(p5, NN3), 4).alias("p5_tm"), name(3).alias("p3_name"), F.concat(p3, F.lit(TRIPLE_RIGHT_TAIL)).alias("p3"), F.round(tm(p3, NN3), 4).alias("p3_tm"))


def set_metrics(sets: DataFrame) -> DataFrame:
    """gene_id, set_id, gap, span, mean_tm, mean_gc."""
    return sets.select("gene_id", "set_id", (F.col("right_start") - F.col("left_end")).alias("gap"), (F.col("right_end") - F.col("start")).alias("span"), F.round((tm("left_seq") + tm("right_seq")) / 2, 4).alias("mean_tm"), F.round((gc_percent("left_seq") + gc_percent("right_seq")) / 2, 4).alias("mean_gc"))
