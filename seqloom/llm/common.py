"""What the training-data operators share: scratch tables, word rules, null ids.

Words are maximal runs of bytes outside space and 0x09-0x0D, which is exactly
what ``bytes.split()`` and :data:`SPACE` give.  A null ``doc_id`` counts as one
id below every other (:data:`NO_ID`) and is returned as null again.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NO_ID = -(2**63)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query when it has ended; the table it wrote stays.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later plans start from the
    files, so a lost executor costs a re-read and not the lineage, and the shuffles behind the table
    give their disk back at once."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression (keeps it out of inner loops)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def row_id(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def own_id(name: str = "doc_id") -> Column:
    """Undo :func:`row_id`."""
    return F.when(F.col(name) != NO_ID, F.col(name)).alias("doc_id")


def every(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: A column that tells the rows of a table apart.
NUMBER = "__seqloom_number"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with the column ``NUMBER``, unlike in all rows and in the order of (doc_id, text): doc_id itself
    where it is so, a running number, written to scratch, where ids are null or repeat."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if ids.isEmpty():
        return docs.withColumn(NUMBER, F.col("doc_id").cast("long"))
    return cut(docs.orderBy(F.col("doc_id").asc_nulls_first(), "text").withColumn(NUMBER, F.monotonically_increasing_id()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
