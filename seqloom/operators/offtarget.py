"""Off-target search: exact seeds are equi-joined, diagonals verified by mismatch count.

Hits are ungapped, of the probe's whole length, at the least identity, and hold an exact seed; that is what a
word-seeded search finds.  Seeds of both strands of the subjects are rows; a frequent seed is an
ordinary skewed equi-join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .kmers import BLOCK, blocks

#: Bases in a packed number.
_WORD = 21
#: Numbers of the letters; of a place outside a sequence -1; other letters than ACGT count as one.
_LETTER = np.full(256, 4, np.int64)
_LETTER[list(b"ACGT.")] = [0, 1, 2, 3, -1]


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance of two sequences of one length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda n, x: n + x)


def packed_places(seqs: DataFrame, seed: int, reach: int, *keys: str) -> DataFrame:
    """keys, pos, code, ahead*, behind*, room, rest: every ``seed``-mer of ACGT as a number, with the ``reach`` bases before and
    behind it, the nearest one lowest, in numbers of ``_WORD`` bases, and how many of them the sequence has.  Cut block by block; a
    row is a few numbers."""
    width, words = seed + 2 * reach, -(-reach // _WORD)
    padded = seqs.select(*keys, F.concat(F.lit("." * reach), "seq", F.lit("." * reach)).alias("seq"))
    cut = blocks(padded, width, *keys, least=width).select(*keys, "offset", "b")
    kinds = dict(cut.dtypes)
    names = [*keys, "pos", "code", *[f"{side}{i}" for side in ("ahead", "behind") for i in range(words)], "room", "rest"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                texts = part.column(len(keys) + 1).to_pylist()
                size = np.array([len(t) for t in texts])
                wide = max(int(size.max()), width) if len(size) else width
                raw = np.frombuffer(b"".join(t.ljust(wide, b".") for t in texts), np.uint8).reshape(len(texts), wide)
                letters = _LETTER[raw]
                n = min(wide - width + 1, BLOCK)
                at = lambda i: letters[:, i : i + n]  # noqa: E731, B023
                good = np.arange(n) + width <= size[:, None]
                code = np.zeros((len(texts), n), np.int64)
                for i in range(seed):
                    good &= (at(reach + i) >= 0) & (at(reach + i) < 4)
                    code = code * 4 + np.maximum(at(reach + i), 0)
                row, place = np.nonzero(good)
                sides = []
                for start, step in ((reach - 1, -1), (reach + seed, 1)):
                    packed, held = np.zeros((words, len(row)), np.int64), np.zeros(len(row), np.int32)
                    inside = np.ones(len(row), bool)
                    for i in range(reach):
                        letter = letters[row, place + start + step * i]
                        inside &= letter >= 0
                        held += inside
                        packed[i // _WORD] |= np.maximum(letter, 0) << (3 * (i % _WORD))
                    sides.append(([pa.array(p) for p in packed], pa.array(held)))
                (ahead, room), (behind, rest) = sides
                taken = pa.array(row)
                offset = np.asarray(part.column(len(keys)))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(taken) for i in range(len(keys))], pa.array((offset[row] + place).astype(np.int32)), pa.array(code[row, place]), *ahead, *behind, room, rest], names)

    return cut.mapInArrow(pack, ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{c} {'int' if c in ('pos', 'room', 'rest') else 'long'}" for c in names[len(keys) :]]]))


def _differing(side: str, bases: Column, words: int) -> Column:
    """At how many of their first ``bases`` the flanks of a probe's seed and of a place differ."""
    total = F.lit(0)
    for i in range(words):
        x = F.col(f"{side}{i}").bitwiseXOR(F.col(f"{side}{i}_p"))
        each = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2))
        n = F.least(F.greatest(bases - _WORD * i, F.lit(0)), F.lit(_WORD))
        ones = F.call_function("shiftright", F.lit(int("1" * _WORD, 8)), 3 * (_WORD - n))  # one bit a base
        total = total + F.bit_count(each.bitwiseAND(ones))
    return total.cast("int")


def search(probes: DataFrame, subjects: DataFrame, seed: int = 10, identity: float = 0.8, max_mismatches: int | None = None) -> DataFrame:
    """probe_seq, subject_id, strand, start, mm. ``probes``: probe_seq; ``subjects``: subject_id, strand, seq.

    Seeds and places are dealt by the seed with the bases about them, so a diagonal is verified on the row it is found in; it counts
    at its first seed alone, so nothing that is found moves again."""
    queries = written(probes.select("probe_seq").distinct().filter(F.length("probe_seq") >= seed))
    longest = queries.agg(F.max(F.length("probe_seq"))).first()[0] or seed
    reach = longest - seed
    words = -(-reach // _WORD)
    seeds = packed_places(queries.select("probe_seq", F.col("probe_seq").alias("seq")), seed, reach, "probe_seq").withColumnsRenamed({"pos": "at", "rest": "rest_p"}).drop("room")
    seeds = seeds.withColumnsRenamed({f"{side}{i}": f"{side}{i}_p" for side in ("ahead", "behind") for i in range(words)})
    # written, as subjects may be costly to derive and are cut into many rows
    places = packed_places(written(subjects.select("subject_id", "strand", "seq")), seed, reach, "subject_id", "strand")
    # what a probe's seeds and a subject's places come to is not in their files' sizes, so neither is to be sent through the driver
    met = seeds.join(places.hint("merge"), "code").filter((F.col("room") >= F.col("at")) & (F.col("rest") >= F.col("rest_p")))
    most = F.floor(F.length("probe_seq") * F.lit(1 - identity) + 1e-9) if max_mismatches is None else F.lit(max_mismatches)
    before, behind = _differing("ahead", F.col("at"), words), _differing("behind", F.col("rest_p"), words)
    # an equal base before the seed means an earlier seed, and so does any run of a seed's length further ahead
    near = F.col("ahead0").bitwiseXOR(F.col("ahead0_p")).bitwiseAND(F.lit(7)) if words else F.lit(1)
    other = F.col("ahead0").bitwiseAND(F.lit(7)) == 4 if words else F.lit(False)
    first = met.filter((F.col("at") == 0) | (near != 0) | other).filter(before + behind <= most)
    if reach > seed:
        first = first.filter(~_run_ahead(seed, words))
    return first.select("probe_seq", "subject_id", "strand", (F.col("pos") - F.col("at")).alias("start"), (before + behind).alias("mm"))


def _run_ahead(seed: int, words: int) -> Column:
    """The flanks before a seed agree over ``seed`` bases in a row, within the probe and all of ACGT."""
    base = lambda x, i: F.call_function("shiftright", F.get(F.array(*[F.col(f"ahead{j}{x}") for j in range(words)]), F.floor(i / _WORD).cast("int")), (3 * (i % _WORD)).cast("int")).bitwiseAND(F.lit(7))
    same = lambda i: (base("", i) == base("_p", i)) & (base("", i) < 4)
    longer = lambda a, i: F.when(a == seed, a).when(same(i), a + 1).otherwise(0)
    return (F.col("at") >= seed) & (F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("at") - 1, F.lit(0))), F.lit(0), longer) == seed)


def histogram(hits: DataFrame) -> DataFrame:
    """probe_seq, mm, n."""
    return hits.groupBy("probe_seq", "mm").agg(F.count("*").alias("n"))


def evidence(probes: DataFrame, hits: DataFrame) -> DataFrame:
    """probe_seq, n_hits, min_mm, exact, one: no hit counts as mismatch 0."""
    per = hits.groupBy("probe_seq").agg(F.count("*").alias("n_hits"), F.min("mm").alias("min_mm"), F.sum((F.col("mm") == 0).cast("int")).alias("exact"), F.sum((F.col("mm") == 1).cast("int")).alias("one"))
    return probes.select("probe_seq").distinct().join(per.hint("merge"), "probe_seq", "left").na.fill(0, ["n_hits", "min_mm", "exact", "one"])


def set_scores(sets: DataFrame, per_probe: DataFrame, probes: list[str]) -> DataFrame:
    """``sets`` with ``score`` (10 * least mismatch + 5 for each further match, over its probes) and
    ``specificity`` (10 * exact + 2 * one mismatch)."""
    out, score, specificity = sets, F.lit(0), F.lit(0)
    for p in probes:
        e = per_probe.select(F.col("probe_seq").alias(p), F.struct("n_hits", "min_mm", "exact", "one").alias(f"_{p}"))
        out = out.join(e.hint("merge"), p, "left")
        score = score + F.coalesce(F.col(f"_{p}.min_mm"), F.lit(0)) * 10 + F.greatest(F.coalesce(F.col(f"_{p}.n_hits"), F.lit(0)) - 1, F.lit(0)) * 5
        specificity = specificity + F.coalesce(F.col(f"_{p}.exact"), F.lit(0)) * 10 + F.coalesce(F.col(f"_{p}.one"), F.lit(0)) * 2
    return out.withColumn("score", score.cast("long")).withColumn("specificity", specificity.cast("long")).drop(*[f"_{p}" for p in probes])


def rank(sets: DataFrame) -> DataFrame:
    """Sets of a gene numbered by ``score``, equal ones in the order they were designed."""
    return sets.withColumn("set_id", F.row_number().over(Window.partitionBy("gene_id").orderBy("score", "set_id")))
