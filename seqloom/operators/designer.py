"""Probe design as a set-based plan.

``first(p)`` is the end of the shortest valid window at p.  A set is feasible at s when the windows
chain from s (left, then middle, then right after the inner gap) and do not dimerise.  The
scan accepts feasible starts in order, each at or behind the end of the set before: an orbit of pointers from
start to start, walked tile by tile.

A block of a sequence holds all windows and sets that start in it, so they are enumerated, tested and chained block by
block, in arrays, and shuffle nothing; the k-mers of sequences longer than a block alone are shuffled, to find repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import gc_junction, once, reverse_complement
from ..functions.thermo import GAS, NN4, SALT, STRANDS, Table, pair_values
from ..sources.scratch import spread, written
from .kmers import BLOCK, blocks, explode_kmers, repeat_kmers
from .orbits import orbit


@dataclass(frozen=True)
class Config:
    """Parameters of a design; ``min_gap`` is accepted and inert, as selection spaces the sets."""

    min_length: int = 15
    max_length: int = 20
    gc_min: float = 40.0
    gc_max: float = 60.0
    tm_min: float = 45.0
    tm_max: float = 55.0
    min_gap: int = 15
    inner_gap: int = 0
    kmer_size: int = 8
    min_kmer_count: int = 2
    min_complementary_length: int = 5
    poly_n: int = 5
    max_selected: int = 5
    arity: int = 2
    table: Table = NN4

    def __post_init__(self) -> None:
        if self.min_length > self.max_length:
            raise ValueError(f"min_length {self.min_length} is above max_length {self.max_length}")
        if not 0 <= self.gc_min <= self.gc_max <= 100:
            raise ValueError(f"GC range {self.gc_min} to {self.gc_max} is not within 0 to 100")
        if not 0 <= self.tm_min <= self.tm_max <= 100:
            raise ValueError(f"temperature range {self.tm_min} to {self.tm_max} is not within 0 to 100")
        if self.arity not in (2, 3):
            raise ValueError("a set has two or three probes")


DUAL = Config()
TRIPLE = Config(tm_min=47.0, tm_max=53.0, poly_n=4, arity=3)


def windows(genes: DataFrame, config: Config = DUAL) -> DataFrame:
    """gene_id, start, len, w of every window of every length, and the packed values of its pairs."""
    # dealt over the cores before a block becomes thousands of windows
    at = spread(blocks(genes, config.max_length, "gene_id"), "gene_id", "offset").filter(F.octet_length("b") >= config.min_length).withColumn("values", pair_values(F.col("b"), config.table))
    last = F.least(F.octet_length("b") - config.min_length, F.lit(BLOCK - 1))
    at = at.select("gene_id", "offset", "b", once(F.col("values"), "values"), last.alias("last")).select("gene_id", "offset", "b", "values", F.explode(F.sequence(F.lit(0), "last")).alias("at"))
    pieces = at.select("gene_id", (F.col("offset") + F.col("at")).alias("start"), "at", "values", once(F.substring("b", F.col("at") + 1, F.lit(config.max_length)).cast("string"), "piece"))
    sized = pieces.select("gene_id", "start", "at", "values", "piece", F.explode(F.sequence(F.lit(config.min_length), F.lit(config.max_length))).alias("len"))
    return sized.filter(F.col("len") <= F.length("piece")).select("gene_id", "start", "len", once(F.substring("piece", F.lit(1), F.col("len")), "w"), "at", "values")


def _first_repeat(genes: DataFrame, config: Config) -> DataFrame:
    """gene_id, start, repeat: the first repeated k-mer at or after ``start``, where one is in reach of a window."""
    k, reach = config.kmer_size, config.max_length - config.kmer_size
    found = explode_kmers(genes, k, "gene_id").join(repeat_kmers(genes, k, config.min_kmer_count), ["gene_id", "kmer"], "left_semi")
    near = found.select("gene_id", "pos", F.explode(F.sequence(F.greatest(F.col("pos") - reach, F.lit(0)), "pos")).alias("start"))
    return near.groupBy("gene_id", "start").agg(F.min("pos").alias("repeat"))


def _laid(genes: DataFrame, config: Config, reach: int) -> DataFrame:
    """gene_id, n, offset, b, repeated: the blocks of the genes and where they hold repeated k-mers; null where a block is the
    whole gene, which tells them itself.  The k-mers of longer genes alone are shuffled."""
    k, width = config.kmer_size, BLOCK + reach - 1
    cut = spread(blocks(genes.select("gene_id", "seq", F.length("seq").alias("n")), reach, "gene_id", "n"), "gene_id", "offset")
    long_ = genes.filter(F.length("seq") > BLOCK)
    found = explode_kmers(long_, k, "gene_id").join(repeat_kmers(long_, k, config.min_kmer_count), ["gene_id", "kmer"], "left_semi")
    first = F.greatest(F.ceil((F.col("pos") + k - width) / BLOCK), F.lit(0)).cast("int")
    near = found.select("gene_id", "pos", F.explode(F.sequence(first, F.floor(F.col("pos") / BLOCK).cast("int"))).alias("block"))
    marks = near.groupBy("gene_id", (F.col("block") * BLOCK).alias("offset")).agg(F.collect_list(F.col("pos") - F.col("block") * BLOCK).alias("repeated"))
    whole = cut.filter(F.col("n") <= BLOCK).withColumn("repeated", F.lit(None).cast("array<int>"))
    rest = cut.filter(F.col("n") > BLOCK).join(marks, ["gene_id", "offset"], "left").withColumn("repeated", F.coalesce("repeated", F.array().cast("array<int>")))
    return whole.unionByName(rest.select(*whole.columns))


#: Blocks that a task works on at once.
_ROWS = 256
_LETTER = np.full(256, -1, np.int64)
_LETTER[list(b"ACGT")] = range(4)


def _codes(letters: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for the k-mer at each place of the rows, and for its reverse complement."""
    n = max(letters.shape[1] - k + 1, 0)
    code, other = np.zeros((len(letters), n), np.int64), np.zeros((len(letters), n), np.int64)
    for i in range(k):
        code += letters[:, i : i + n] << (2 * (k - 1 - i))
        other += (3 - letters[:, i : i + n]) << (2 * i)
    return code, other


class _Windows:
    """The windows of some blocks, in arrays: a row a block, a column a start."""

    def __init__(self, texts: list[bytes], repeated: list[list[int] | None], config: Config) -> None:
        self.config, self.size = config, np.array([len(t) for t in texts])
        wide = max(int(self.size.max()), config.max_length)
        self.bytes = np.frombuffer(b"".join(t.ljust(wide, b"A") for t in texts), np.uint8).reshape(len(texts), wide)
        self.letters = _LETTER[self.bytes]
        if (self.letters < 0).any():
            raise ValueError("a sequence to design on has letters other than ACGT")
        self.repeat = self._repeats(repeated)
        since = lambda x: np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1, dtype=np.int64)], axis=1)
        self.gc = since((self.letters == 1) | (self.letters == 2))
        known = dict(config.table.pairs) | {reverse: v for p, v in config.table.pairs.items() for reverse in [p[::-1].translate(str.maketrans("ACGT", "TGCA"))]}
        pair = self.letters[:, :-1] * 4 + self.letters[:, 1:]
        self.heat, self.entropy = (since(np.array([known[a + b][i] for a in "ACGT" for b in "ACGT"])[pair]) for i in (0, 1))
        runs = np.ones((len(texts), max(wide - config.poly_n + 1, 0)), bool)
        for i in range(1, config.poly_n):
            runs &= self.letters[:, i : i + runs.shape[1]] == self.letters[:, : runs.shape[1]]
        self.runs = since(runs)

    def _repeats(self, repeated: list[list[int] | None]) -> np.ndarray:
        """How many repeated k-mers start before each place."""
        k = self.config.kmer_size
        code, other = _codes(self.letters, k)
        marks = np.zeros(code.shape, bool)
        for i, places in enumerate(repeated):
            if places is not None:
                marks[i, places] = True
            elif self.size[i] >= k:
                own = code[i, : self.size[i] - k + 1]
                kinds, at, n = np.unique(own, return_index=True, return_counts=True)
                often = n >= self.config.min_kmer_count
                if often.any():
                    marks[i, : len(own)] = np.isin(own, np.concatenate([kinds[often], other[i, at[often]]]))
        return np.concatenate([np.zeros((len(marks), 1), np.int64), np.cumsum(marks, axis=1)], axis=1)

    def valid(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which starts have a window of this length that passes every test, and its temperature."""
        c, n = self.config, self.letters.shape[1] - length + 1
        within = lambda total, size: total[:, length - size + 1 : length - size + 1 + n] - total[:, :n]
        gc = within(self.gc, 1) * 100.0 / length
        ok = (np.arange(n) + length <= self.size[:, None]) & (gc >= c.gc_min) & (gc <= c.gc_max)
        if length >= c.poly_n:
            ok &= within(self.runs, c.poly_n) == 0
        if length >= c.kmer_size:
            ok &= within(self.repeat, c.kmer_size) == 0
        weak = (self.letters[:, :n] % 3 == 0).astype(np.int64) + (self.letters[:, length - 1 : length - 1 + n] % 3 == 0)  # ends of A or T
        end = lambda i: weak * c.table.end_at[i] + (2 - weak) * c.table.end_gc[i] + c.table.start[i]
        heat, entropy = within(self.heat, 2) + end(0), within(self.entropy, 2) + end(1)
        tm = 1000.0 * (heat / 10.0) / ((entropy / 10.0 + 0.368 * (length - 1) * math.log(SALT)) + GAS * math.log(STRANDS)) - 273.15
        return ok & (tm >= c.tm_min) & (tm <= c.tm_max), tm

    def ends(self) -> np.ndarray:
        """The end of the shortest valid window at each start; 0 without one."""
        out = np.zeros(self.letters.shape, np.int64)
        for length in range(self.config.max_length, self.config.min_length - 1, -1):
            ok, _ = self.valid(length)
            out[:, : ok.shape[1]] = np.where(ok, np.arange(ok.shape[1]) + length, out[:, : ok.shape[1]])
        return out

    def texts(self, row: np.ndarray, start: np.ndarray, end: np.ndarray, turned: bool = False) -> pa.Array:
        """The bases from ``start`` to ``end``, or their reverse complements."""
        size = end - start
        step = np.arange(int(size.max()) if len(size) else 0)
        at = end[:, None] - 1 - step if turned else start[:, None] + step
        inside = step < size[:, None]
        found = self.bytes[row[:, None], np.where(inside, at, 0)]
        if turned:
            found = np.frombuffer(bytes.maketrans(b"ACGT", b"TGCA"), np.uint8)[found]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(found[inside].tobytes())])

    def dimers(self, row: np.ndarray, probes: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which sets of windows have halves, or two windows, that pair over the least complementary length."""
        m = self.config.min_complementary_length
        code, other = _codes(self.letters, m)
        step = np.arange(max(self.config.max_length - m + 1, 0))

        def meet(a, b, c, d):
            x, y = a[:, None] + step, c[:, None] + step
            left = np.where(x <= b[:, None] - m, other[row[:, None], np.minimum(x, code.shape[1] - 1)], -1)
            right = np.where(y <= d[:, None] - m, code[row[:, None], np.minimum(y, code.shape[1] - 1)], -2)
            return (left[:, :, None] == right[:, None, :]).any(axis=(1, 2))

        out = np.zeros(len(row), bool)
        for i, (a, b) in enumerate(probes):
            half = b - (b - a) // 2  # of the turned probe the first half ends here
            out |= (b - a >= 2 * m) & meet(half, b, a, half)
            for c, d in probes[i + 1 :]:
                out |= meet(a, b, c, d)
        return out


def _scanned(laid: DataFrame, config: Config, rows, columns: str) -> DataFrame:
    """What ``rows`` (windows, sizes of genes, offsets -> row of the block, further columns) finds in the blocks, by gene_id."""
    kind = dict(laid.dtypes)["gene_id"]
    names = ["gene_id", *[c.split()[0] for c in columns.split(", ")]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = batch.slice(low, _ROWS)
                found = _Windows(part.column(3).to_pylist(), part.column(4).to_pylist(), config)
                row, *values = rows(found, np.asarray(part.column(1)), np.asarray(part.column(2)))
                plain = [v if isinstance(v, pa.Array) else pa.array(v if v.dtype == np.float64 else v.astype(np.int32)) for v in values]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *plain], names)

    return laid.select("gene_id", "n", "offset", "b", "repeated").mapInArrow(scan, f"gene_id {kind}, {columns}")


def candidates(genes: DataFrame, config: Config = DUAL) -> DataFrame:
    """gene_id, start, len, w, tm of the windows that pass every test."""

    def rows(found: _Windows, n: np.ndarray, offset: np.ndarray):
        parts = []
        for length in range(config.min_length, config.max_length + 1):
            ok, tm = found.valid(length)
            row, at = np.nonzero(ok[:, :BLOCK])
            parts.append((row, at, np.full(len(row), length), tm[row, at]))
        row, at, size, tm = (np.concatenate(x) for x in zip(*parts, strict=True))
        return row, at + offset[row], size, found.texts(row, at, at + size), tm

    return _scanned(_laid(genes, config, config.max_length), config, rows, "start int, len int, w string, tm double")


def _shortest(genes: DataFrame, config: Config) -> DataFrame:
    """gene_id, start, len, w: the shortest valid window of each position that has one."""

    def rows(found: _Windows, n: np.ndarray, offset: np.ndarray):
        end = found.ends()[:, :BLOCK]
        row, at = np.nonzero(end)
        return row, at + offset[row], end[row, at] - at, found.texts(row, at, end[row, at])

    return _scanned(_laid(genes, config, config.max_length), config, rows, "start int, len int, w string")


def first_valid(genes: DataFrame, config: Config = DUAL) -> DataFrame:
    """gene_id, start, len of these windows."""
    return _shortest(genes, config).drop("w")


def feasible(genes: DataFrame, config: Config = DUAL) -> DataFrame:
    """gene_id, n, start, left_end, [middle_end,] right_start, right_end and the probes, reverse-complemented.

    Blocks reach as far as a set, so its windows chain within the block of its start."""
    triple = config.arity == 3
    sides = ["left", *["middle"] * triple, "right"]

    def rows(found: _Windows, n: np.ndarray, offset: np.ndarray):
        ends = found.ends()
        ends = np.concatenate([ends, np.zeros((len(ends), config.max_length + config.inner_gap + 1), np.int64)], axis=1)
        row, start = np.nonzero(ends[:, :BLOCK])
        left_end = ends[row, start]
        inner = ends[row, left_end] if triple else left_end
        right_start = inner + config.inner_gap
        right_end = np.where(inner > 0, ends[row, right_start], 0)
        keep = (right_end > 0) & (right_start + offset[row] < n[row] - config.min_length)
        row, start, left_end, inner, right_start, right_end = (x[keep] for x in (row, start, left_end, inner, right_start, right_end))
        probes = [(start, left_end), *[(left_end, inner)] * triple, (right_start, right_end)]
        keep = ~found.dimers(row, probes)
        row, probes = row[keep], [(a[keep], b[keep]) for a, b in probes]
        places = [probes[0][0], probes[0][1], *[probes[1][1]] * triple, probes[-1][0], probes[-1][1]]
        return row, n[row], *[x + offset[row] for x in places], *[found.texts(row, a, b, turned=True) for a, b in probes]

    columns = ["n int", "start int", "left_end int", *["middle_end int"] * triple, "right_start int", "right_end int", *[f"{s}_seq string" for s in sides]]
    reach = config.arity * config.max_length + config.inner_gap
    return _scanned(_laid(genes, config, reach), config, rows, ", ".join(columns))


def accept(sets: DataFrame, config: Config = DUAL) -> DataFrame:
    """The scan: the feasible rows that it takes, with ``set_id`` from 1 in order.

    With a gap narrower than a window nothing fits inside a set, so the scan goes on from a set's end: each feasible start
    points to the next one, and the scan is the orbit of these pointers.  With wider gaps, see :func:`accept_nested`."""
    if config.inner_gap >= config.max_length:
        raise ValueError("with an inner gap of a window's length or more, sets start inside others: use accept_nested")
    bound = F.col("n") - 3 * config.min_length
    slim = written(sets.select(F.col("gene_id").cast("string").alias("key"), F.col("start").cast("long").alias("pos"), F.col("right_end").cast("long").alias("end"), (F.col("left_end") < bound).alias("on"), (F.col("start") < bound).alias("free")))
    # the scan stops at the bound, but a set before it still reaches a start right at its end
    asked = slim.select("key", F.col("end").alias("at"), F.lit(1).alias("asks"), "pos", "on", F.lit(None).cast("long").alias("any"), F.lit(None).cast("long").alias("free"))
    there = slim.select("key", F.col("pos").alias("at"), F.lit(0).alias("asks"), "pos", "on", F.col("pos").alias("any"), F.when(F.col("free"), F.col("pos")).alias("free"))
    behind = Window.partitionBy("key").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = asked.union(there).select("key", "at", "asks", "pos", "on", F.last("any", True).over(behind).alias("any"), F.last("free", True).over(behind).alias("free"))
    pointed = seen.filter("asks = 1").select("key", "pos", F.when(F.col("on") & (F.col("any") == F.col("at")), F.col("any")).otherwise(F.col("free")).alias("next"))
    first = slim.filter("free").groupBy("key").agg(F.min("pos").alias("pos"))
    taken = orbit(pointed, first).select(F.col("key").alias("_key"), F.col("pos").alias("_pos"))
    kept = sets.join(taken.hint("merge"), (F.col("gene_id").cast("string") == F.col("_key")) & (F.col("start") == F.col("_pos"))).drop("_key", "_pos")
    return _numbered(kept)


def _numbered(kept: DataFrame) -> DataFrame:
    columns = [c for c in kept.columns if c != "gene_id"]
    return kept.select("gene_id", F.row_number().over(Window.partitionBy("gene_id").orderBy("start")).alias("set_id"), *columns)


def accept_nested(first: DataFrame, genes: DataFrame, config: Config = DUAL) -> DataFrame:
    """gene_id, number, start, left_end, [middle_end,] right_start, right_end: the scan of sets whose inner gap holds
    others, from the shortest valid windows (gene_id, start, end, w) and the genes (gene_id, seq).

    What the scan may take at a position depends on the bases that the last sets use ahead of it, so it is one walk over a
    gene's positions; it keeps the used bases within reach alone.  A window must be free of used bases for the longest
    window's length, and a right window moves on to the first place that is."""
    triple, reach, gap, low = config.arity == 3, config.max_length, config.inner_gap, config.min_length
    least = config.min_complementary_length
    comp = bytes.maketrans(b"ACGT", b"TGCA")

    def dimer(probes: list[bytes]) -> bool:
        def meet(a: bytes, b: bytes) -> bool:
            other = b.translate(comp)[::-1]
            return any(a[i : i + least] in other for i in range(len(a) - least + 1))

        halves = any(len(p) >= 2 * least and meet(p[: len(p) // 2], p[len(p) // 2 :]) for p in probes)
        return halves or any(meet(a, b) for i, a in enumerate(probes) for b in probes[i + 1 :])

    def scan(block: pa.Table) -> pa.Table:
        n, gene = block.column("n")[0].as_py(), block.column("gene_id")[0].as_py()
        window = {p: (e, w.encode()) for p, e, w in zip(block.column("start").to_pylist(), block.column("end").to_pylist(), block.column("w").to_pylist(), strict=True) if p is not None}
        probe = lambda p: window[p][1].translate(comp)[::-1]
        used: list[tuple[int, int]] = []  # of the last sets, in order

        def free(p: int) -> int:
            """The first place from ``p`` on whose ``reach`` bases are free."""
            for a, b in used:
                if a < p + reach and p < b:
                    p = b
            return p

        out: list[tuple] = []
        pos, upto = 0, n - low
        while pos < n - 3 * low:
            left = free(pos)
            found = None
            if left <= upto and left in window:
                end = window[left][0]
                inner = end
                if triple:
                    inner = window[end][0] if end <= upto and end in window and free(end) == end and not dimer([probe(left), probe(end)]) else None
                if inner is not None and inner + gap < n - low:
                    right = free(inner + gap)
                    if right <= upto and right in window and not dimer([probe(left), *([probe(end)] if triple else []), probe(right)]):
                        found = (left, end, inner, right, window[right][0])
            if found is None:
                pos += 1
                used = [u for u in used if u[1] > pos]
                continue
            out.append(found)
            used = sorted([*used, (left, inner), (found[3], found[4])])
            pos = end
            used = [u for u in used if u[1] > pos]
        columns = list(zip(*out, strict=True)) or [()] * 5
        values = [pa.array([gene] * len(out), block.schema.field("gene_id").type), pa.array(range(1, len(out) + 1), pa.int32()), *(pa.array(list(c), pa.int32()) for c in columns)]
        return pa.table(values, ["gene_id", "set_id", "start", "left_end", "middle_end", "right_start", "right_end"])

    kind = dict(genes.dtypes)["gene_id"]
    sized = genes.select("gene_id", F.length("seq").alias("n"))
    grouped = sized.join(first.select("gene_id", "start", "end", "w"), "gene_id").groupBy("gene_id")
    out = grouped.applyInArrow(scan, f"gene_id {kind}, set_id int, start int, left_end int, middle_end int, right_start int, right_end int")
    return out if triple else out.drop("middle_end")


def design(genes: DataFrame, config: Config = DUAL) -> DataFrame:
    """gene_id, set_id, start, ends, probes and gc_junction of the designed sets."""
    if config.inner_gap < config.max_length:
        return accept(feasible(genes, config), config).withColumn("gc_junction", gc_junction("left_seq"))
    first = written(_shortest(genes, config).select("gene_id", "start", (F.col("start") + F.col("len")).alias("end"), "w"))
    out = accept_nested(first, genes, config)
    sides = [("left", "start"), *[("middle", "left_end")] * (config.arity == 3), ("right", "right_start")]
    for side, at in sides:
        out = out.join(first.select("gene_id", F.col("start").alias(at), reverse_complement("w").alias(f"{side}_seq")), ["gene_id", at])
    ends = ["start", "left_end", *["middle_end"] * (config.arity == 3), "right_start", "right_end"]
    return out.select("gene_id", "set_id", *ends, *[f"{side}_seq" for side, _ in sides]).withColumn("gc_junction", gc_junction("left_seq"))


def _greedy(intervals: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, start, end, *order of a largest choice of a key's intervals that do not touch: by end, then ``order``, each that
    starts behind the last end."""
    ends = F.struct(F.col("end").cast("long").alias("end"), *order)
    # of equal ends the first in order that starts late enough may be any, so all are kept; a position is an end and start
    marked = intervals.select(F.col(key).cast("string").alias("key"), F.col("start").cast("long").alias("start"), ends.alias("x"))
    best = marked.groupBy("key", "start").agg(F.min("x").alias("x"))
    behind = Window.partitionBy("key").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, 0)
    late = F.when(F.col("asks") == 0, F.struct(F.col("x"), F.col("start")))
    there = best.select("key", F.col("start").alias("at"), F.lit(0).alias("asks"), "x", "start")
    asked = best.select("key", F.col("x.end").alias("at"), F.lit(1).alias("asks"), "x", "start").groupBy("key", "at", "asks").agg(F.min("x").alias("x"), F.min("start").alias("start"))
    seen = there.union(asked).select("key", "at", "asks", F.min(late).over(behind).alias("next"))
    # an end points to the end of the interval to take next
    nodes = seen.filter("asks = 1").select("key", F.col("at").alias("pos"), F.col("next"))
    nodes = written(nodes)
    first = marked.groupBy("key").agg(F.min(F.struct(F.col("x"), F.col("start"))).alias("first"))
    ends_ = orbit(nodes.select("key", "pos", F.col("next.x.end").alias("next")), first.select("key", F.col("first.x.end").alias("pos")))
    taken = nodes.join(ends_, ["key", "pos"]).select("key", "next").filter("next is not null").union(first.select("key", "first"))
    return taken.select(F.col("key").alias(key), F.col("next.start").alias("start"), F.col("next.x.end").alias("end"), *[F.col(f"next.x.{c}").alias(c) for c in order])


#: Intervals of a key that a task takes at once.
_HELD = 1 << 16


def _by_size(intervals: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """The intervals of keys that a task takes at once, and those of the others, where there are some."""
    known = written(intervals.filter(F.col(key).isNotNull()))
    whole = (F.count("*") <= _HELD) & (F.count("start") == F.count("*")) & (F.count("end") == F.count("*"))
    large = written(known.groupBy(key).agg(whole.alias("whole")).filter("not whole").select(key))
    if large.isEmpty():
        return known, None
    return known.join(large, key, "left_anti"), known.join(large, key, "left_semi")


def _walked(block: pa.Table, order: list[str]) -> tuple[pa.Table, np.ndarray]:
    """The intervals of a key by end, then ``order``, and which of them start behind the end of the one taken before."""
    by = pc.sort_indices(block, [(c, "ascending") for c in ("end", *order, "start")], null_placement="at_start")
    block, last = block.take(by), None
    taken = np.zeros(len(block), bool)
    for i, (start, end) in enumerate(zip(block.column("start").to_pylist(), block.column("end").to_pylist(), strict=True)):
        if last is None or start > last:
            taken[i], last = True, end
    return block, taken


def disjoint_intervals(intervals: DataFrame, key: str) -> DataFrame:
    """key, start, end: most intervals of a key that do not touch - by end, take what starts behind the last end."""
    kinds = dict(intervals.dtypes)

    def walk(block: pa.Table) -> pa.Table:
        block, taken = _walked(block, [])
        return block.filter(pa.array(taken))

    small, large = _by_size(intervals.select(key, "start", "end"), key)
    out = small.groupBy(key).applyInArrow(walk, f"`{key}` {kinds[key]}, start {kinds['start']}, end {kinds['end']}")
    return out if large is None else out.unionByName(_disjoint_large(large, key))


def _disjoint_large(intervals: DataFrame, key: str) -> DataFrame:
    """The same along an orbit, for keys of any number of intervals."""
    kinds = dict(intervals.dtypes)
    taken = _greedy(intervals.select(key, "start", "end", F.col("start").cast("long").alias("_first")), key, ["_first"])
    return taken.select(F.col(key).cast(kinds[key]).alias(key), F.col("start").cast(kinds["start"]).alias("start"), F.col("end").cast(kinds["end"]).alias("end"))


def scheduled_intervals(intervals: DataFrame, key: str, order: str) -> DataFrame:
    """key, start, end, order, best, before, taken: the table of the dynamic program over a key's intervals sorted by end, equal
    ends by ``order``: the largest number of intervals up to each, how many end before it starts, and whether the way
    back from the last takes it - the first row of each number, as a row is taken where the number rises."""
    kinds = dict(intervals.dtypes)

    def solve(block: pa.Table) -> pa.Table:
        block, taken = _walked(block, [order])
        before = np.searchsorted(block.column("end").to_numpy(), block.column("start").to_numpy())
        for name, values in (("best", np.cumsum(taken)), ("before", before), ("taken", taken)):
            block = block.append_column(name, pa.array(values))
        return block

    small, large = _by_size(intervals.select(key, "start", "end", order), key)
    out = small.groupBy(key).applyInArrow(solve, f"`{key}` {kinds[key]}, start {kinds['start']}, end {kinds['end']}, `{order}` {kinds[order]}, best long, before long, taken boolean")
    return out if large is None else out.unionByName(_scheduled_large(large, key, order))


def _scheduled_large(intervals: DataFrame, key: str, order: str) -> DataFrame:
    """The same along an orbit, for keys of any number of intervals."""
    kinds = dict(intervals.dtypes)
    named = intervals.select(F.col(key).cast("string").alias("key"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(order).alias("order"))
    taken = _greedy(named, "key", ["order"]).withColumn("taken", F.lit(True))
    marked = named.join(taken, ["key", "start", "end", "order"], "left").withColumn("taken", F.coalesce("taken", F.lit(False)))
    upto = Window.partitionBy("key").orderBy("end", "order").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumn("best", F.sum(F.col("taken").cast("int")).over(upto))
    # how many ends lie before a start
    ends = named.select("key", F.col("end").alias("at"), F.lit(1).alias("n"), F.lit(None).cast("long").alias("start"))
    asked = named.select("key", F.col("start").alias("at"), F.lit(0).alias("n"), "start").distinct()
    order_ = Window.partitionBy("key").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    before = ends.union(asked).withColumn("before", F.sum("n").over(order_)).filter("start is not null").select("key", "start", "before")
    out = counted.join(before, ["key", "start"])
    return out.select(F.col("key").cast(kinds[key]).alias(key), F.col("start").cast(kinds["start"]).alias("start"), F.col("end").cast(kinds["end"]).alias("end"), F.col("order").alias(order), F.col("best").cast("long").alias("best"), F.col("before").cast("long").alias("before"), "taken")
