"""Orbits of increasing pointers: which positions of a key a walk visits that jumps from each to its next.

Positions lie in tiles.  Each tile works out for itself where the walk leaves it from each of its positions; these
exits are doubled until the walk from every key's first position is known tile by tile, in rounds that grow with the
logarithm of the tiles of the longest key (none, where one tile holds it); then each tile walks from where it is
entered.  So a chromosome is as many rows and tasks as it has tiles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Positions of a tile.
TILE = 4096


def _tile(position: str):
    return F.floor(F.col(position) / TILE).cast("long")


def _exits(nodes: DataFrame) -> DataFrame:
    """key, pos, exit: the first position of the walk from ``pos`` in another tile; null where it ends before."""

    def leave(block: pa.Table) -> pa.Table:
        pos, nxt = block.column("pos").to_pylist(), block.column("next").to_pylist()
        tile, out = pos[0] // TILE, {}
        for k in np.argsort(pos)[::-1].tolist():
            q = nxt[k]
            out[pos[k]] = q if q is None or q // TILE != tile else out[q]
        return pa.table({"key": block.column("key"), "pos": block.column("pos"), "exit": pa.array([out[p] for p in pos], pa.int64())})

    return nodes.groupBy("key", "tile").applyInArrow(leave, "key string, pos long, exit long")


def _entries(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """key, pos at which the walk from ``first`` (key, pos) enters each tile."""
    last = nodes.agg(F.max("pos")).first()[0]
    if last is None or last < TILE:
        return first
    exits = _exits(nodes)
    # from the positions alone that a walk may enter a tile at
    targets = exits.filter("exit is not null").select("key", F.col("exit").alias("pos")).union(first).distinct()
    jumps, power = [written(exits.join(targets, ["key", "pos"]).filter("exit is not null").select("key", "pos", F.col("exit").alias("to")))], 1
    while power * TILE <= last:
        then = jumps[-1].select("key", F.col("pos").alias("to"), F.col("to").alias("further"))
        further = written(jumps[-1].join(then, ["key", "to"]).select("key", "pos", F.col("further").alias("to")))
        if further.isEmpty():
            break
        jumps.append(further)
        power *= 2
    reached = first
    for jump in reversed(jumps):
        reached = written(reached.union(reached.join(jump, ["key", "pos"]).select("key", F.col("to").alias("pos"))))
    return reached.distinct()


def orbit(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """key, pos of the walks. ``nodes``: key (string), pos, next (a greater pos of the key, or null), one row a position;
    ``first``: key, pos where each walk begins."""
    nodes = written(nodes.withColumn("tile", _tile("pos")))
    entries = _entries(nodes, first.select("key", "pos")).select("key", _tile("pos").alias("tile"), F.col("pos").alias("want"))
    tiles = nodes.groupBy("key", "tile").agg(F.sort_array(F.collect_list(F.struct("pos", "next"))).alias("nodes")).join(entries, ["key", "tile"])
    state = F.struct(F.col("want"), F.array().cast("array<bigint>").alias("taken"))
    step = lambda a, x: F.when(x["pos"] == a["want"], F.struct(F.coalesce(x["next"], F.lit(-1)).alias("want"), F.array_append(a["taken"], x["pos"]).alias("taken"))).otherwise(a)
    return tiles.select("key", F.explode(F.aggregate("nodes", state, step, lambda a: a["taken"])).alias("pos"))
