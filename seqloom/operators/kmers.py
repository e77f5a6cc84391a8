"""K-mer tables: counts on both strands, repeats within a gene, the most frequent background k-mer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmers, reverse_complement


#: Starts in a block of a sequence.
BLOCK = 1024


def blocks(seqs: DataFrame, reach: int, *keys: str, seq: str = "seq", least: int = 1) -> DataFrame:
    """keys, offset, b: sequences of ``least`` bytes or more, as bytes, in overlapping blocks of ``BLOCK`` starts with
    ``reach`` bytes each: however long a sequence is, a row stays small."""
    raw = seqs.select(*keys, F.col(seq).cast("binary").alias("b")).filter(F.octet_length("b") >= least)
    cut = raw.select(*keys, "b", F.explode(F.sequence(F.lit(0), F.octet_length("b") - least, F.lit(BLOCK))).alias("offset"))
    return cut.select(*keys, "offset", F.substring("b", F.col("offset") + 1, F.lit(BLOCK + reach - 1)).alias("b"))


def piece_blocks(pieces: DataFrame, reach: int, *keys: str, least: int = 1) -> DataFrame:
    """The :func:`blocks` of sequences that come in pieces (keys, offset, piece): each piece goes to the blocks that
    hold some of it, and only the pieces of one block meet."""
    first = F.greatest(F.floor((F.col("offset") - (reach - 1)) / BLOCK), F.lit(0)).cast("long")
    last = F.floor((F.col("offset") + F.length("piece") - 1) / BLOCK).cast("long")
    laid = pieces.filter(F.length("piece") > 0).select(*keys, "offset", "piece", F.explode(F.sequence(first, last)).alias("block"))
    from_ = F.greatest(F.col("block") * BLOCK - F.col("offset"), F.lit(0))
    upto = F.least(F.col("block") * BLOCK + BLOCK + reach - 1 - F.col("offset"), F.length("piece"))
    cut = laid.select(*keys, "block", "offset", F.substring("piece", (from_ + 1).cast("int"), (upto - from_).cast("int")).alias("piece")).filter("piece <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"]), "")
    out = cut.groupBy(*keys, "block").agg(joined.alias("b")).filter(F.length("b") >= least)
    return out.select(*keys, (F.col("block") * BLOCK).alias("offset"), F.col("b").cast("binary").alias("b"))


def explode_kmers(seqs: DataFrame, k: int, *keys: str, seq: str = "seq") -> DataFrame:
    """keys, pos (0-based), kmer. One row per k-mer, cut block by block; nothing is shuffled."""
    return block_kmers(blocks(seqs, k, *keys, seq=seq, least=k), k, *keys)


def block_kmers(cut: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, pos, kmer of blocks with a reach of ``k`` or more."""
    starts = F.substring(F.col("b").cast("string"), 1, BLOCK + k - 1)
    each = cut.select(*keys, "offset", F.posexplode(kmers(starts, k)).alias("at", "kmer"))
    return each.select(*keys, (F.col("offset") + F.col("at")).alias("pos"), "kmer")


def both_strand_counts(seqs: DataFrame, k: int = 9) -> DataFrame:
    """kmer, cnt over forward and reverse strand. The forward counts, summed map-side first, are
    turned round rather than the sequences, so one strand is exploded and shuffled."""
    forward = explode_kmers(seqs.select(F.upper("seq").alias("seq")), k).groupBy("kmer").agg(F.count("*").alias("n"))
    strands = forward.select("n", F.explode(F.array("kmer", reverse_complement("kmer"))).alias("kmer"))
    return strands.groupBy("kmer").agg(F.sum("n").alias("cnt"))


def repeat_kmers(genes: DataFrame, k: int = 8, least: int = 2) -> DataFrame:
    """gene_id, kmer: k-mers seen ``least`` times in a gene, and their reverse complements."""
    often = explode_kmers(genes, k, "gene_id").groupBy("gene_id", "kmer").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return often.select("gene_id", F.explode(F.array("kmer", reverse_complement("kmer"))).alias("kmer")).distinct()


def most_frequent_kmer(probes: DataFrame, background: DataFrame, k: int = 9, key: str = "bp_id") -> DataFrame:
    """key, kmer, cnt, a row a key: the k-mer of its rows with the highest background count, ties to the least; NA, 0 if it has none."""
    own = probes.select(key, F.explode(F.array_distinct(kmers(F.upper("seq"), k))).alias("kmer"))
    best = own.join(background, "kmer", "left").groupBy(key).agg(F.min_by(F.struct("kmer", F.coalesce("cnt", F.lit(0)).alias("cnt")), F.struct(-F.coalesce("cnt", F.lit(0)), F.col("kmer"))).alias("b"))
    return probes.select(key).distinct().join(best, key, "left").select(key, F.coalesce("b.kmer", F.lit("NA")).alias("kmer"), F.coalesce("b.cnt", F.lit(0)).cast("long").alias("cnt"))
