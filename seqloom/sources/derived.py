"""Deterministic sequence tables derived from the driver's tables (they hold no DNA)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import spread

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"
GENE_PARTS = 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(text: Column) -> Column:
    return F.translate(F.md5(text), HEX, DNA)


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    parts = [dna(F.concat(key, F.lit(f"-{i}"))) for i in range(GENE_PARTS)]
    return spread(read(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey").select(F.col("s_suppkey").alias("gene_id"), F.concat(*parts).alias("seq"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("BP_"), F.lpad(key, 5, "0")).alias("bp_id"), F.substring(dna(key), 1, 19).alias("seq"), F.col("p_partkey").alias("ord"))


def isoforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(F.concat(F.lit("G"), F.col("c_nationkey").cast("string"), F.lit("."), key.cast("string")).alias("id"), F.substring(dna(key.cast("string")), F.lit(1), (10 + key % 20).cast("int")).alias("seq"), key.alias("ord"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by gene; the last tenth of the ids are not genes."""
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    ids = (F.col("user_id") % (F.col("n") + F.col("n") / 10).cast("long")).alias("gene_id")
    return read(spark, sf_dir, "events").join(F.broadcast(n)).select(ids, F.col("value")).groupBy("gene_id").agg(F.sum(F.round("value", 2).cast("decimal(18,2)")).cast("double").alias("count"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes with every base i complemented where (i + gene_id) % 13 = 0, and the other strand."""
    flip = F.array_join(F.transform(F.sequence(F.lit(1), F.length("seq")), lambda i: F.when((i + F.col("gene_id")) % 13 == 0, F.translate(F.substring(F.col("seq"), i, F.lit(1)), "ACGT", "TGCA")).otherwise(F.substring(F.col("seq"), i, F.lit(1)))), "")
    forward = genes(spark, sf_dir).select(F.col("gene_id").alias("subject_id"), F.lit("+").alias("strand"), flip.alias("seq"))
    return forward.union(forward.select("subject_id", F.lit("-"), F.reverse(F.translate("seq", "ACGT", "TGCA"))))


def gapped_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes without every base i where (i + gene_id) % 41 = 0 and with a T more behind it where (i + gene_id) % 43 = 0, and
    the other strand."""
    at = F.sequence(F.lit(1), F.length("seq"))
    letter = lambda i: F.when((i + F.col("gene_id")) % 41 == 0, "").when((i + F.col("gene_id")) % 43 == 0, F.concat(F.substring(F.col("seq"), i, F.lit(1)), F.lit("T"))).otherwise(F.substring(F.col("seq"), i, F.lit(1)))
    forward = genes(spark, sf_dir).select(F.col("gene_id").alias("subject_id"), F.lit("+").alias("strand"), F.array_join(F.transform(at, letter), "").alias("seq"))
    return forward.union(forward.select("subject_id", F.lit("-"), F.reverse(F.translate("seq", "ACGT", "TGCA"))))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA-like records of mixed quality: gene pieces, protein-like letters, junk characters."""
    key = F.col("c_custkey")
    piece = F.substring(dna(key.cast("string")), F.lit(1), (8 + key % 24).cast("int"))
    seq = (
        F.when(key % 11 == 0, F.concat(piece, F.lit("#?")))
        .when(key % 7 == 0, F.translate(piece, "ACGT", "MKLV"))
        .when(key % 5 == 0, F.lower(piece))
        .when(key % 13 == 0, F.concat(piece, F.lit("NNNN")))
        .when(key % 17 == 0, F.lit(""))
        .otherwise(piece)
    )
    header = F.concat(F.lit("G"), F.col("c_nationkey").cast("string"), F.when(key % 2 == 0, ".").otherwise("-"), (key % 5).cast("string"), F.lit(" from customer "), key.cast("string"))
    return read(spark, sf_dir, "customer").select(header.alias("header"), seq.alias("seq"), key.alias("ord"))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol -> locus for every third gene; ``L`` + gene_id is the locus."""
    return genes(spark, sf_dir).filter("gene_id % 3 = 0").select(F.concat(F.lit("SYM"), F.col("gene_id").cast("string")).alias("symbol"), F.concat(F.lit("L"), F.col("gene_id").cast("string")).alias("locus"))


def libraries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three id -> seq tables that overlap: coding, transcript and reference, in order of precedence."""
    named = genes(spark, sf_dir).select(F.concat(F.lit("L"), F.col("gene_id").cast("string")).alias("id"), F.col("seq"), F.col("gene_id").alias("ord"))
    coding = named.filter("ord % 2 = 0").select("id", F.substring("seq", 1, 120).alias("seq"), "ord")
    transcript = named.filter("ord % 5 <> 1").select("id", F.substring("seq", 1, 240).alias("seq"), "ord")
    reference = named.select(F.concat("id", F.lit("."), (F.col("ord") % 3 + 1).cast("string")).alias("id"), "seq", "ord")
    return coding, transcript, reference


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Design requests: some genes by alias, some unknown; some probes unknown; some without a limit."""
    k = F.col("o_orderkey")
    n = read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    gene = (k % (F.col("n") + 3)).cast("string")
    return (
        read(spark, sf_dir, "orders").join(F.broadcast(n))
        .select(F.concat(F.lit("T"), k.cast("string")).alias("task"), F.concat(F.lit("BP_"), F.lpad((k % 2500).cast("string"), 5, "0")).alias("bp_id"), F.when(k % 4 == 0, F.concat(F.lit("SYM"), gene)).when(k % 9 == 0, F.concat(F.lit("l"), gene)).otherwise(F.concat(F.lit("L"), gene)).alias("gene_id"), F.when(k % 3 == 0, (k % 7 + 1).cast("string")).when(k % 3 == 1, "many").alias("max_selected"))
    )
