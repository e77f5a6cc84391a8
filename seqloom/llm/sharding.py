"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups are equal texts.  Small groups fall by hash into a fixed number of
chunks; groups larger than a chunk stand alone, and those larger than
``1 / PER_SHARD`` of a shard are split into pieces of that size by doc_id, as a
whole hot group fits no shard.  That leaves a number of items bounded by the
shard count alone (:func:`item_bound`), whatever the input; their three sums come
to the driver, which places the largest first, each where the dot product with
the residual capacity is highest among the shards that still have room.

Slots: items of a shard lie one after the other, rows inside an item are
numbered by (doc_id, fingerprint), so numbering needs no task with a whole shard.

Edge cases: a null text has 16 bytes, no tokens and crc32 0, and is equal to the
empty text; null doc_ids sort first; repeated rows have slots of their own; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, words

SHARDS = 40
#: Chunks for each shard; an item is at most about 1/PER_SHARD of a shard.
PER_SHARD = 64
OVERHEAD = 16


def item_bound(shards: int, per_shard: int) -> int:
    """Chunks, plus lone groups of at least half a chunk in one of three measures, plus pieces."""
    return shards * per_shard * (1 + 3 * 2 + 3)


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every item; ``items`` has a row (bytes, tokens, rows) each."""
    total = items.sum(axis=0)
    share = items / np.maximum(total, 1) * shards  # a shard's capacity is 1 in every measure
    left = np.ones((shards, share.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in sorted(range(len(items)), key=lambda j: (-share[j].max(), j)):
        score = left @ share[i]
        room = (left - share[i]).min(axis=1) >= 0
        # when nothing has room in all measures, bytes decide: the emptiest shard takes it
        out[i] = np.argmax(np.where(room, score, -np.inf)) if room.any() else np.argmax(left[:, 0])
        left[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = SHARDS, per_shard: int = PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.size(words(F.col("text"))).cast("long").alias("tokens"),
            F.xxhash64(text).alias("group"),
        )
    )
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    chunks = shards * per_shard
    limit = [max((total[k] or 0) / chunks, 1.0) for k in ("size", "tokens", "rows")]
    weight = F.greatest(*[F.col(k) / v for k, v in zip(("size", "tokens", "rows"), limit, strict=True)])
    # groups of half a chunk and more stand alone: at most 3 * 2 * chunks of them
    lone = rows.groupBy("group").agg(*sums).filter(weight >= 0.5).select("group", F.ceil(weight).cast("long").alias("pieces"))
    chunk = F.pmod(F.xxhash64("group", F.lit(1)), F.lit(chunks))
    piece = F.pmod(F.xxhash64("doc_id", "group"), F.col("pieces"))
    named = rows.join(F.broadcast(lone), "group", "left").withColumn("item", F.when(F.col("pieces").isNull(), F.struct(F.lit(0).cast("long").alias("a"), chunk.alias("b"))).otherwise(F.struct((piece + 1).alias("a"), F.col("group").alias("b"))))
    found = named.groupBy("item").agg(*sums).collect()
    found.sort(key=lambda r: (r["item"]["a"], r["item"]["b"]))
    if len(found) > item_bound(shards, per_shard):
        raise RuntimeError(f"{len(found)} items to pack; the bound is {item_bound(shards, per_shard)}")
    into = pack(np.array([[r["size"], r["tokens"], r["rows"]] for r in found], dtype=float).reshape(-1, 3), shards)
    starts, plan = [0] * shards, []
    for r, s in zip(found, into.tolist(), strict=True):
        plan.append((r["item"]["a"], r["item"]["b"], s, starts[s]))
        starts[s] += r["rows"]
    plan = spark.createDataFrame(plan, "a long, b long, shard int, start long")
    within = Window.partitionBy("item").orderBy("doc_id", "group")
    return (
        named.withColumn("rank", F.row_number().over(within) - 1)
        .join(F.broadcast(plan), (F.col("item.a") == F.col("a")) & (F.col("item.b") == F.col("b")))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
