"""Readers of the engine's text formats. Files are read by Spark's own sources, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import written


#: Bits of a line's number within its range of a file; bases in a row of :func:`fasta_pieces`.
_LINE_BITS, PIECE = 33, 4096


def _records(lines: DataFrame, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records of FASTA lines (file, block, line, value), as a segmented scan: names (record, id, header, ord) and
    pieces (record, offset, piece) of the records that stay, of equal ids the last one at the first one's place, or ``every`` one.

    A header is ``>`` at a line's start.  Each range of a file numbers its bases behind its own headers; the table of
    ranges, one row each, carries the open record and its bases so far to the lines before a range's first header."""
    head = F.startswith("value", F.lit(">"))
    bare = lines.select("file", "block", "line", F.when(head, F.trim(F.substring(F.col("value"), F.lit(2), F.length("value")), F.lit("\r "))).alias("header"), F.when(~head, F.regexp_replace("value", r"\s+", "")).alias("piece")).filter("header is not null or piece <> ''")
    within = Window.partitionBy("file", "block")
    own = F.last(F.when(F.col("header").isNotNull(), F.col("line")), True).over(within.orderBy("line"))
    before = F.sum(F.length("piece")).over(Window.partitionBy("file", "block", "own").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    placed = written(bare.withColumn("own", own).withColumn("at", F.coalesce(before, F.lit(0))))

    ranges = placed.groupBy("file", "block").agg(F.max(F.struct(F.coalesce("own", F.lit(-1)).alias("own"), (F.col("at") + F.coalesce(F.length("piece"), F.lit(0))).alias("bases"))).alias("x")).select("file", "block", "x.*")
    ordered, record = Window.partitionBy("file").orderBy("block"), lambda line: F.shiftleft("number", _LINE_BITS).bitwiseOR(F.col(line))
    numbers = ranges.withColumn("number", F.row_number().over(Window.orderBy("file", "block")).cast("long"))
    opened = numbers.withColumn("open", F.last(F.when(F.col("own") >= 0, record("own")), True).over(ordered))
    summed = opened.withColumn("sum", F.sum("bases").over(Window.partitionBy("file", "open").orderBy("block")))
    carried = summed.select("file", "block", "number", F.lag("open").over(ordered).alias("carried"), F.lag("sum").over(ordered).alias("carried_bases"))

    full = placed.join(carried, ["file", "block"]).withColumn("record", F.when(F.col("own").isNotNull(), record("own")).otherwise(F.col("carried")))
    headers = full.filter("header is not null").select("record", F.get(F.split("header", r"\s+"), F.lit(0)).alias("id"), "header")
    names = headers.select("record", "id", "header", F.col("record").alias("ord")) if every else headers.groupBy("id").agg(F.max_by(F.struct("record", "header"), "record").alias("x"), F.min("record").alias("ord")).select("x.record", "id", "x.header", "ord")
    pieces = full.filter("piece is not null and record is not null").select("record", (F.col("at") + F.when(F.col("own").isNull(), F.col("carried_bases")).otherwise(0)).alias("offset"), "piece")
    return names, pieces


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files with their range of the file and their number in it."""
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _LINE_BITS) - 1))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), number.alias("line"), "value")


def _whole(names: DataFrame, pieces: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"]), "")
    return names.join(pieces.groupBy("record").agg(joined.alias("seq")), "record", "left").select("id", "header", F.coalesce("seq", F.lit("")).alias("seq"), "ord")


def fasta(spark: SparkSession, path: str, every: bool = False) -> DataFrame:
    """id, header, seq, ord: a row holds a whole sequence. ord rises with a record's place in the files; of equal ids the
    last sequence wins, at the first one's place, but ``every`` record stays where that is asked for.  Lines before the first
    header are none's."""
    return _whole(*_records(_lines(spark, path), every))


def fasta_pieces(spark: SparkSession, path: str) -> DataFrame:
    """id, header, ord, offset, piece: the sequences of :func:`fasta` line by line, in pieces of ``PIECE`` bases at most, so
    that a chromosome never is one row; ``kmers.piece_blocks`` makes windows of them."""
    names, pieces = _records(_lines(spark, path))
    cut = pieces.select("record", "offset", "piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1, F.lit(PIECE))).alias("at"))
    return cut.join(names, "record").select("id", "header", "ord", (F.col("offset") + F.col("at")).alias("offset"), F.substring("piece", F.col("at") + 1, F.lit(PIECE)).alias("piece"))


def fasta_texts(uploads: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """The records of FASTA texts held in rows, as :func:`fasta` gives those of files; rows are read in the order of ``key``."""
    split = uploads.select(F.col(key).alias("file"), F.lit(0).alias("block"), F.posexplode(F.split(F.col(text), r"\r\n|\r|\n")).alias("line", "value"))
    return _whole(*_records(split.withColumn("line", F.col("line").cast("long"))))


def gene_alias(spark: SparkSession, path: str) -> DataFrame:
    """symbol, locus, both upper-cased; of equal symbols the last wins. Tab-separated, Latin-1."""
    rows = spark.read.option("sep", "\t").option("encoding", "ISO-8859-1").csv(path).select(F.upper("_c1").alias("symbol"), F.upper("_c0").alias("locus"), F.monotonically_increasing_id().alias("ord"))
    return rows.filter("symbol is not null").groupBy("symbol").agg(F.max_by("locus", "ord").alias("locus"))


def _columns(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("c"), F.monotonically_increasing_id().alias("ord")).filter(F.get("c", F.lit(0)) != "")


def bridge(spark: SparkSession, path: str) -> DataFrame:
    """bp_id, seq, ord of lines with two columns."""
    return _columns(spark, path).filter(F.size("c") >= 2).select(F.get("c", F.lit(0)).alias("bp_id"), F.get("c", F.lit(1)).alias("seq"), "ord")


def existing_probes(spark: SparkSession, path: str) -> DataFrame:
    """seq: the first column of lines that are neither blank nor comments."""
    return _columns(spark, path).select(F.get("c", F.lit(0)).alias("seq")).filter(~F.startswith("seq", F.lit("#")))


def batch_requests(spark: SparkSession, path: str, default: int = 5) -> DataFrame:
    """task, bp_id, gene_id, max_selected of a headerless CSV with three columns or four."""
    schema = "task string, bp_id string, gene_id string, max_selected string"
    rows = spark.read.schema(schema).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.filter("gene_id is not null").withColumn("max_selected", F.coalesce(F.expr("try_cast(max_selected AS INT)"), F.lit(default)))


def probe_csv(spark: SparkSession, path: str) -> DataFrame:
    """probe_id, seq of a CSV with a header, whatever its names."""
    rows = spark.read.option("header", True).schema("probe_id string, seq string").option("enforceSchema", True).csv(path)
    return rows.filter("seq is not null").select(F.trim("probe_id").alias("probe_id"), F.trim("seq").alias("seq"))


def expression_counts(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, count; lines without a number are skipped, the last of equal ids wins."""
    rows = _columns(spark, path).select(F.get("c", F.lit(0)).alias("gene_id"), F.expr("try_cast(get(c, 1) AS DOUBLE)").alias("count"), "ord").filter("count is not null")
    return rows.groupBy("gene_id").agg(F.max_by("count", "ord").alias("count"))


def id_list(spark: SparkSession, path: str | None = None, listed: str = "") -> DataFrame:
    """id, ord: a file's lines and a comma list, distinct, in order of first mention."""
    parts = [x.strip() for x in listed.split(",") if x.strip()]
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(parts)], "id string, ord long")
    if path:
        rows = spark.read.text(path).select(F.trim("value").alias("id"), (F.monotonically_increasing_id() - F.lit(2**62)).alias("ord")).filter("id <> ''").union(rows)
    return rows.groupBy("id").agg(F.min("ord").alias("ord"))


_PROBE = T.StructType([
    T.StructField("sequence", T.StringType()),
    T.StructField("position", T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])),
    T.StructField("length", T.IntegerType()),
    T.StructField("gc_content", T.StringType()),
    T.StructField("tm", T.StringType()),
    T.StructField("blast_results", T.StructType([
        T.StructField("mismatch_stats", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("detailed_matches", T.ArrayType(T.StructType([T.StructField("subject_id", T.StringType()), T.StructField("mismatches", T.IntegerType()), T.StructField("gaps", T.IntegerType())]))),
    ])),
])
PROBE_SETS = T.StructType([T.StructField("probe_sets", T.ArrayType(T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("left_probe", _PROBE), T.StructField("middle_probe", _PROBE), T.StructField("right_probe", _PROBE),
    T.StructField("evaluation", T.StructType([T.StructField("quality_score", T.StringType()), T.StructField("has_gc_junction", T.BooleanType()), T.StructField("total_span", T.IntegerType())])),
    T.StructField("keep", T.BooleanType()), T.StructField("reason", T.StringType()),
])))])


def probe_sets(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """One row per set of the nested documents, with ``intervals`` and the score as a number, and, if asked for, ``source``: a
    field of the file's metadata (``_metadata.``) or else of the documents, as text.  A file holds a document or an array of them."""
    named = [F.col(source).alias("source")] if source else []
    own = [T.StructField(source, T.StringType())] if source and not source.startswith("_metadata.") else []
    sets = spark.read.schema(T.StructType([*PROBE_SETS.fields, *own])).json(path, multiLine=True).select(F.explode("probe_sets").alias("s"), *named).select("s.*", *["source"] * len(named))
    position = lambda p: F.col(f"{p}.position")
    return sets.withColumn("intervals", F.array_compact(F.array(*[position(p) for p in ("left_probe", "middle_probe", "right_probe")]))).withColumn("score", F.expr("try_cast(evaluation.quality_score AS DOUBLE)"))
