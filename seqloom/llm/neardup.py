"""Near duplicates by DartMinHash signatures and banded joins.

Elements of a text are its word shingles, weighted by their count (``weights="count"``) or 1 each
(``"set"``); similarity is the weighted Jaccard one, the sum of the lesser weights over the sum of the
greater.  Darts fall on the plane (weight, rank) of every
element as a Poisson process drawn from the element's hash alone, cell by cell:
strip ``v`` of weight covers ``[2**v - 1, 2**(v + 1) - 1)`` and its cells have area 1.
A text sees the darts below its element's weight and below rank
``expected / total weight``, about ``expected`` darts however long it is; each dart is
hashed to one of ``k`` coordinates, and the earliest of a coordinate is its
minhash.  Texts with empty coordinates look further up in rank.  Two signatures agree in a
coordinate with the probability of their weighted Jaccard similarity.

Copies (equal word sequences) fold into one node first.  In each band bucket the
node that meets most others over all its buckets leads, as the original of a family does;
members are compared with leaders by the exact similarity of their weighted shingles, and classes
are the connected components.  A bucket that still holds several classes mixed texts that are
similar, but not enough; its nodes go on to finer buckets, of two and then three
bands joined, with leaders of their own.  That costs n comparisons a level for a bucket of n texts
and joins most of what is similar.  The texts of all band buckets that
held several classes at first are finished by a prefix-filtered join, exact among them: elements ordered by rarity, the
first ones of the smaller text against the first ones of the larger, sizes bounded, candidates verified.  So two
similar texts are in one class unless they share no band at all, at the threshold 3e-6.  Texts that share bands but are
not similar differ first of all in elements of their own, which meet nobody, so a family of them costs what its elements do.

Edge cases: a text of 1 to ``size - 1`` words is one shingle; a text without words
(null, empty, blank) is in a class of its own; rows that share a doc_id are in one
class; a null doc_id is below all others, with class null where it is the least; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, cut, row_id
from .hashing import U, WordHashes, mix, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Levels of buckets (bands joined in a key), and the distances of the bands that are joined.
LEVELS, STEPS = 3, (1, 5, 11)
#: Shingles that a task lays out in arrays at once.
CHUNK = 100_000
_GOLDEN = U(0x9E3779B97F4A7C15)
_CELL = U(0xD1B54A32D192ED03)
#: Poisson(1): a cell holds as many darts as thresholds lie below its hash.
_POISSON = np.array([min(2**64 - 1, int(sum(math.exp(-1) / math.factorial(j) for j in range(m + 1)) * 2**64)) for m in range(16)], U)


def shingles(tokens: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Shingle hashes of a text's word hashes, in order; a short text is one shingle."""
    return window_hashes(tokens, min(size, len(tokens))) if len(tokens) else np.empty(0, U)


def _throw(elements, weights, owner, reach, k, n, out_rank, out_dart):
    """Darts of weighted elements below their owners' ``reach`` in rank; the earliest stay in out_*."""
    strips = int(math.log2(weights.max() + 1)) + 1 if len(weights) else 0
    for v in range(strips):
        low, width = 2.0**v - 1, 2.0**v
        inside = np.flatnonzero(weights > low)
        cells = np.ceil(reach[owner[inside]] * width).astype(np.int64)
        element = np.repeat(inside, cells)
        j = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
        base = mix(elements[element] + _CELL * (j.astype(U) + U(1)) + U(v * int(_GOLDEN) % 2**64))
        darts = np.searchsorted(_POISSON, base)
        cell = np.repeat(np.arange(len(element)), darts)
        d = np.arange(len(cell)) - np.repeat(np.cumsum(darts) - darts, darts)
        dart = mix(base[cell] + _GOLDEN * (d.astype(U) + U(1)))
        rank = (j[cell] + (dart >> U(32)).astype(float) / 2**32) / width
        who = owner[element[cell]]
        seen = rank < reach[who]
        if v or weights.max() < 1:
            height = low + (mix(dart) >> U(32)).astype(float) / 2**32 * width
            seen &= height < weights[element[cell]]
        dart, rank, who = dart[seen], rank[seen], who[seen]
        slot = who * k + (dart & U(0xFFFFFF)).astype(np.int64) % k
        order = np.argsort(-rank, kind="stable")
        slot, rank, dart = slot[order], rank[order], dart[order]
        best = np.full(n * k, np.inf)
        best_dart = np.zeros(n * k, U)
        best[slot], best_dart[slot] = rank, dart  # the last written is the earliest
        better = best < out_rank
        out_rank[better], out_dart[better] = best[better], best_dart[better]


def signatures(texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """k minhashes of every text, given its elements and weights (none is empty)."""
    n = len(texts)
    rank, dart = np.full(n * k, np.inf), np.zeros(n * k, U)
    total = np.array([w.sum() for _, w in texts])
    reach = k * (math.log(k) + 2) / total
    todo = np.arange(n)
    while len(todo):
        elements = np.concatenate([texts[i][0] for i in todo])
        weights = np.concatenate([texts[i][1] for i in todo])
        owner = np.repeat(todo, [len(texts[i][0]) for i in todo])
        _throw(elements, weights, owner, reach, k, n, rank, dart)
        todo = np.flatnonzero(np.isinf(rank.reshape(n, k)).any(axis=1))
        reach[todo] *= 4
    return dart.reshape(n, k)


def sketches(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weights: str = "count") -> DataFrame:
    """doc_id, k1, k2 (print of the word sequence; null without words), bands (hash of each)."""
    k = bands * rows

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            keys: list = [None] * batch.num_rows
            hashes = np.zeros((batch.num_rows, bands), U)
            held, at, laid = [], [], 0
            for i, text in enumerate(batch.column(1)):
                tokens = text.as_py().split()
                if tokens:
                    w = cache.of(tokens)
                    keys[i] = xxhash.xxh3_128_digest(w.tobytes())
                    s = shingles(w, size)
                    if weights == "count":
                        s, n = np.unique(s, return_counts=True)
                    else:
                        n = np.ones(len(s))
                    held.append((s, n.astype(float)))
                    at.append(i)
                    laid += len(s)
                if held and (laid >= CHUNK or i == batch.num_rows - 1):
                    sig = signatures(held, k).reshape(len(held), bands, rows)
                    out = np.broadcast_to(np.arange(bands, dtype=U) * _CELL, sig.shape[:2])
                    for r in range(rows):
                        out = mix(out * _GOLDEN + sig[:, :, r])
                    hashes[at] = out
                    held, at, laid = [], [], 0
            if held:
                sig = signatures(held, k).reshape(len(held), bands, rows)
                out = np.broadcast_to(np.arange(bands, dtype=U) * _CELL, sig.shape[:2])
                for r in range(rows):
                    out = mix(out * _GOLDEN + sig[:, :, r])
                hashes[at] = out
            part = lambda a: pa.array([None if x is None else int.from_bytes(x[a : a + 8], "big", signed=True) for x in keys], pa.int64())
            flat = pa.array(hashes.view(np.int64).ravel())
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), part(0), part(8), listed], ["doc_id", "k1", "k2", "bands"])

    rows_ = docs.select(row_id().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return rows_.mapInArrow(sketch, "doc_id long, k1 long, k2 long, bands array<long>")


def elements(tokens: np.ndarray, size: int, weights: str) -> np.ndarray:
    """Sorted distinct 32-bit prints of a text's shingles; weighted by count, the j-th of equal shingles is an element
    of its own, so that the weighted similarity of two texts is the similarity of these sets."""
    s = np.sort(shingles(tokens, size))
    if weights == "count":
        heads = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))[: len(s)]
        s = mix(s + _CELL * (np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))).astype(U))
    return np.unique((s >> U(32)).astype(np.uint32))


def _sets(docs: DataFrame, nodes: DataFrame, size: int, weights: str = "count") -> DataFrame:
    """node, items (:func:`elements`, as bytes)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            out = [elements(cache.of(t.as_py().split()), size, weights).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "items"])

    texts = docs.select(row_id().alias("node"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return texts.join(nodes, "node", "left_semi").mapInArrow(build, "node long, items binary")


def _similar(edges: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The edges (a, b) whose shingle sets have Jaccard similarity ``least`` or more."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                if min(len(p), len(q)) < least * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= least * (len(p) + len(q) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
    joined = edges.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "items_a", "items_b")
    return joined.mapInArrow(verify, "a long, b long")


def _elements(members: DataFrame) -> DataFrame:
    """node, label, size, token: every element of the nodes (node, label, items)."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), np.uint32) for x in batch.column(2)]
            if not found:
                continue
            size = np.array([len(x) for x in found])
            of = pa.array(np.repeat(np.arange(len(found)), size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(np.concatenate(found).view(np.int32))], ["node", "label", "size", "token"])

    return members.select("node", "label", "items").mapInArrow(explode, "node long, label long, size int, token int")


def _fits(least: float) -> Column:
    """Whether rows x and y that share a token are of different classes and of sizes and rests that may be similar."""
    # nothing before their first common element is shared, so what is left of both must be enough
    enough = F.least("rest_x", "rest_y") >= F.ceil(F.lit(least / (1 + least)) * (F.col("size_x") + F.col("size_y")) - 1e-9)
    return (F.col("label_x") != F.col("label_y")) & (F.col("size_x") <= F.col("size_y")) & (F.col("size_x") >= F.lit(least) * F.col("size_y") - 1e-9) & enough


def _meetings(reach: DataFrame, least: float) -> DataFrame:
    """token, label_x, size_x, label_y, size_y: the classes and sizes whose members may meet at a token, by the member of
    each with most left.  So a class counts once a size, however many of its texts hold the token."""
    groups = cut(reach.groupBy("token", "label", "size").agg(F.max("rest").alias("rest"), F.max(F.when(F.col("first"), F.col("rest"))).alias("first_rest")))
    x = groups.filter("first_rest is not null").selectExpr("token", "label label_x", "size size_x", "first_rest rest_x")
    y = groups.selectExpr("token", "label label_y", "size size_y", "rest rest_y")
    return x.join(y, "token").filter(_fits(least)).drop("rest_x", "rest_y")


def _candidates(reach: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) to verify among the rows (node, label, rest, size, first, token) of prefixes."""
    x, y = (reach.select("token", *[F.col(c).alias(f"{c}_{side}") for c in ("node", "label", "size", "rest")], *["first"] * (side == "x")) for side in "xy")
    met = cut(_meetings(reach, least))
    pairs = x.filter("first").join(met, ["token", "label_x", "size_x"]).join(y, ["token", "label_y", "size_y"])
    return pairs.filter(_fits(least) & (F.struct("size_x", "node_x") < F.struct("size_y", "node_y"))).select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def _finish(nodes: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The similar pairs (a, b) of different classes among the nodes.

    Elements are ordered by rarity.  Of a pair at the threshold, the smaller text shares one of its first
    ``n - ceil(2 * least / (1 + least) * n) + 1`` elements with the first ``m - ceil(least * m) + 1`` of the larger; texts that differ in
    more than that differ there in elements of their own, which meet nobody.  At the first element that two texts share, as much
    must be left of both as the threshold asks for; classes and sizes that cannot have it do not meet (:func:`_meetings`).  Elements that one class alone holds keep their place in the order
    and are not joined."""
    members = cut(nodes.select("node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(sets, "node"))
    each = _elements(members)
    common = each.groupBy("token").agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("across")).filter("n > 1")
    met = each.join(common, "token").groupBy("node", "label", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token", "across"))).alias("tokens"))
    # an element of a text's own is rarer than all of these
    own = F.col("size") - F.size("tokens")
    first = lambda share: F.col("size") - F.ceil(F.lit(share) * F.col("size") - 1e-9).cast("int") + 1 - own
    reached = met.withColumn("own", own).withColumn("smaller", first(2 * least / (1 + least))).withColumn("larger", first(least)).filter("larger > 0")
    listed = reached.select("node", "label", "size", "own", "smaller", F.posexplode(F.slice("tokens", 1, F.col("larger"))).alias("at", "x"))
    reach = cut(listed.filter("x.across").select("node", "label", F.col("size") - F.col("own") - F.col("at"), "size", (F.col("at") < F.col("smaller")).alias("first"), "x.token").toDF("node", "label", "rest", "size", "first", "token"))
    return _similar(cut(_candidates(reach, least)), sets, least)


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of the buckets (bucket, node) that hold several classes, each row of a bucket once at most."""
    named = shared.join(labels, "node", "left").select("bucket", F.coalesce("label", "node").alias("label"))
    # written, so that the join below is dealt for itself and the rows of a hot bucket can be split
    mixed = cut(named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x < y and n > 2").select("bucket"))
    return shared.select("bucket", "node").join(mixed, "bucket", "left_semi").select("node").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b): label is the least node it is connected with.

    Every label hooks onto its least neighbour and chains of hooks are followed by doubling, so the rounds
    are logarithmic; each starts from written tables."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    labels = cut(both(edges).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    first = True
    while True:
        if not first:
            left, right = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            across = edges.join(left, "a").join(right, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
            hooks = cut(both(across).groupBy("a").agg(F.min("b").alias("to")).filter("to < a"))
            if hooks.isEmpty():
                return labels
            labels = labels.join(hooks.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        # follow labels of labels until nothing moves
        while True:
            over = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            moved = cut(labels.join(over, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            labels = moved.drop("moved")
            if moved.filter("moved").isEmpty():
                break
        first = False


def _keys(level: int, bands: int) -> Column:
    """Bucket keys of a signature: the bands at level 1, several bands joined at higher levels (72 of 24)."""
    at = lambda i: F.get("bands", F.lit(i % bands))
    if level == 1:
        return F.col("bands")
    return F.array(*[F.xxhash64(F.lit(i * 64 + s), *[at(i + s * k) for k in range(level)]) for i in range(bands) for s in STEPS])


def classes(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "count", levels: int = LEVELS) -> DataFrame:
    """doc_id, class_id (least doc_id of its class) for every row."""
    sketched = cut(sketches(docs, size, bands, rows, weights))
    worded = sketched.filter("k1 is not null")
    copies = cut(worded.groupBy("k1", "k2").agg(F.min("doc_id").alias("node")))
    nodes = worded.join(copies, ["k1", "k2"]).filter("doc_id = node").select("node", "bands")
    first_nodes = None  # the nodes of band buckets that level 1 leaves open
    found = tested = labels = sets = None

    def across(edges: DataFrame) -> DataFrame:
        """The edges (a, b) between different classes."""
        if labels is None:
            return edges
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        return edges.join(la, "a", "left").join(lb, "b", "left").filter(F.coalesce("la", "a") != F.coalesce("lb", "b")).drop("la", "lb")

    for level in range(1, levels + 1):
        buckets = nodes.select("node", F.explode(_keys(level, bands)).alias("bucket"))
        # written, so that the join below is dealt for itself and the rows of a hot bucket can be split
        sizes = cut(buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y")).filter("x < y").drop("x", "y"))
        shared = cut(buckets.join(sizes, "bucket"))
        met = shared.groupBy("node").agg(F.sum("n").alias("met"))
        leaders = cut(shared.join(met, "node").groupBy("bucket").agg(F.max_by("node", F.struct("met", F.bitwise_not("node"))).alias("leader")))
        shared = cut(shared.drop("n").join(leaders, "bucket"))
        if sets is None:
            sets = cut(_sets(docs, shared.select("node").distinct(), size, weights))
        pairs = shared.filter("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
        pairs = cut(across(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")))
        similar = _similar(pairs, sets, similarity)
        found = cut(similar if found is None else found.union(similar))
        labels = components(found)
        tested = pairs if tested is None else tested.union(pairs)
        if 1 < level == levels:
            break
        nodes = cut(nodes.join(_open(shared, labels), "node", "left_semi"))
        if level == 1:
            first_nodes = nodes
        if nodes.isEmpty():
            break
    if not first_nodes.isEmpty():
        found = cut(found.union(_finish(first_nodes, labels, sets, similarity)))
        labels = components(found)
    named = copies.join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("class_id"))
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    out = worded.join(named, ["k1", "k2"]).select("doc_id", "class_id").union(sketched.filter("k1 is null").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.select(own("doc_id"), own("class_id"))
