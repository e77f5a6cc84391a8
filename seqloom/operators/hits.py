"""Off-target hits beyond whole, ungapped ones: gapped, trimmed at the ends, and all within some mismatches.

``local`` lays a band of diagonals about every diagonal with an exact seed and takes the best local alignment there, with
affine gap costs; with a band of 0 it is the maximal-scoring segment of the diagonal.  ``gapped`` keeps those as long as
the probe, whose mismatches and gap openings count together.  ``detailed`` finds every place of a probe within ``most``
mismatches: one of a probe's halves has half of them or fewer there, so the words about its halves are the seeds.

Subjects are read from a seed index, a table of their k-mers with the bases about them, so a seed's place is verified on
the row it is found in.  ``kept_index`` writes it once as a bucketed table named by the subjects' content; later
searches join it without moving it.  Work in Python is numpy over Arrow batches of candidates.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import once
from ..sources.scratch import written
from .kmers import BLOCK, blocks, explode_kmers
from .offtarget import mismatches

#: A base beyond the ends of a subject.
OUTSIDE = "."


@dataclass(frozen=True)
class Scores:
    """What columns of an alignment add: a match, a mismatch, the opening of a gap, each of its columns."""

    match: int = 1
    mismatch: int = -3
    opening: int = 5
    column: int = 2


# ---- the seed index


def seed_index(subjects: DataFrame, k: int, reach: int) -> DataFrame:
    """kmer, subject_id, strand, pos, around: every k-mer of the subjects (subject_id, strand, seq) with ``reach`` bases on
    both sides, cut block by block; OUTSIDE stands for what is beyond a subject.  In ``kmer`` N stands for any letter but ACGT."""
    padded = subjects.select("subject_id", "strand", F.concat(F.lit(OUTSIDE * reach), "seq", F.lit(OUTSIDE * reach)).alias("seq"))
    width = k + 2 * reach
    cut = blocks(padded, width, "subject_id", "strand", least=width)
    last = F.least(F.octet_length("b") - width, F.lit(BLOCK - 1))
    at = cut.select("subject_id", "strand", "offset", "b", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    each = at.select("subject_id", "strand", (F.col("offset") + F.col("at")).alias("pos"), F.substring("b", F.col("at") + 1, F.lit(width)).cast("string").alias("around"))
    return each.select(F.regexp_replace(F.substring("around", reach + 1, k), "[^ACGT]", "N").alias("kmer"), "subject_id", "strand", "pos", "around")


def content_digest(subjects: DataFrame) -> str:
    """A name for the subjects' content, whatever the order of their rows."""
    row = F.sha2(F.to_json(F.struct(F.col("subject_id").cast("string"), "strand", "seq")), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    found = subjects.agg(F.count("*"), *[part(i) for i in range(4)]).first()
    return hashlib.sha256(str(tuple(found)).encode()).hexdigest()[:24]


def kept_index(spark: SparkSession, subjects: DataFrame, k: int, reach: int, folder: str, buckets: int = 64) -> DataFrame:
    """The seed index as a table below ``folder``, bucketed by k-mer: built where the folder has none for this content yet.
    Searches against it shuffle their probes alone."""
    name = f"seeds_n_{k}_{reach}_{buckets}_{content_digest(subjects)}"
    path = f"{folder.rstrip('/')}/{name}"
    if not spark.catalog.tableExists(name):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        table = seed_index(subjects, k, reach)
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):  # of an earlier session
            columns = ", ".join(f"{c} {t}" for c, t in table.dtypes)
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{path}'")
        else:
            table.write.mode("overwrite").bucketBy(buckets, "kmer").sortBy("kmer").option("path", path).saveAsTable(name)
    return spark.table(name)


def problems(subjects: DataFrame) -> DataFrame:
    """subject_id, problem of records that a database does not take: an empty sequence, lower case, other letters than
    ATCG, or an id that stands for several sequences."""
    empty = F.when(F.length("seq") == 0, "empty sequence")
    lower = F.when(F.col("seq") != F.upper("seq"), "lower case")
    letters = F.when((F.length("seq") > 0) & ~F.upper("seq").rlike("^[ATCG]+$"), "letters other than ATCG")
    own = subjects.select("subject_id", F.explode(F.array_compact(F.array(empty, lower, letters))).alias("problem"))
    repeated = subjects.groupBy("subject_id").agg(F.count("*").alias("n")).filter("n > 1").select("subject_id", F.lit("repeated id").alias("problem"))
    return own.distinct().union(repeated)


# ---- all places within some mismatches


def halves(n: int, most: int) -> list[tuple[int, int, int]]:
    """Offset, length and most mismatches of the halves of ``n`` bases: with ``most`` mismatches in all, the first half has at most
    half of them, or the second one the rest without one."""
    first = -(-n // 2)
    return [h for h in ((0, first, most // 2), (first, n - first, most - most // 2 - 1)) if h[2] >= 0 and h[1]]


def variants(word: str, most: int, letters: str) -> Iterator[str]:
    """The words that differ from ``word`` in ``most`` places or fewer."""
    for n in range(min(most, len(word)) + 1):
        for places in itertools.combinations(range(len(word)), n):
            for change in itertools.product(*[[x for x in letters if x != word[p]] for p in places]):
                out = list(word)
                for p, x in zip(places, change, strict=True):
                    out[p] = x
                yield "".join(out)


def _seeds(probes: DataFrame, most: int, letters: str) -> DataFrame:
    """probe_seq, offset, kmer: the words that a half of a probe may be where the probe lies with ``most`` mismatches."""

    def vary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for probe in batch.column(0).to_pylist():
                plain = re.sub("[^ACGT]", "N", probe)
                for offset, size, n in halves(len(probe), most):
                    words = list(variants(plain[offset : offset + size], n, letters))
                    yield pa.RecordBatch.from_arrays([pa.array([probe] * len(words)), pa.array([offset] * len(words), pa.int32()), pa.array(words)], ["probe_seq", "offset", "kmer"])

    return probes.mapInArrow(vary, "probe_seq string, offset int, kmer string")


def _hamming(a: str, b: str, longest: int) -> Column:
    """As :func:`mismatches`, written out where sequences are short."""
    if longest > 64:
        return mismatches(F.col(a), F.col(b))
    return sum(((F.substring(a, i, 1) != F.substring(b, i, 1)).cast("int") for i in range(1, longest + 1)), F.lit(0))


def detailed(probes: DataFrame, subjects: DataFrame, most: int = 4, index=None) -> DataFrame:
    """probe_seq, subject_id, strand, start, mm, alignment: every place where a whole probe lies with ``most`` mismatches or
    fewer.  ``index``: k, reach -> a seed index of the subjects, such as a kept one."""
    queries = written(probes.select("probe_seq").distinct().filter(F.length("probe_seq") > most))
    subjects = subjects if index else written(subjects.select("subject_id", "strand", "seq"))
    letters = "ACGT" if subjects.filter(F.col("seq").rlike("[^ACGT]")).isEmpty() else "ACGTN"
    lengths = [r[0] for r in queries.select(F.length("probe_seq").alias("n")).distinct().collect()]  # the lengths of probes
    longest = max(lengths, default=0)
    found = None
    for k in sorted({size for n in lengths for _, size, _ in halves(n, most)}):
        mine = [n for n in lengths if any(size == k for _, size, _ in halves(n, most))]
        reach = -(-max(mine) // 2)
        table = (index or (lambda k, reach: seed_index(subjects, k, reach)))(k, reach)
        seeds = _seeds(queries.filter(F.length("probe_seq").isin(mine)), most, letters).filter(F.length("kmer") == k)
        place = F.col("pos") - F.col("offset")
        window = F.substring("around", reach - F.col("offset") + 1, F.length("probe_seq"))
        # the seeds are hundreds of words a probe, which is not in the size of its file: they are not to be sent through the driver
        met = seeds.join(table.hint("merge"), "kmer").select("probe_seq", "subject_id", "strand", place.alias("start"), once(window, "w"))
        good = met.filter(~F.contains("w", F.lit(OUTSIDE))).select("*", once(_hamming("probe_seq", "w", longest), "mm")).filter(F.col("mm") <= most)
        found = good if found is None else found.union(good)
    if found is None:
        return probes.sparkSession.createDataFrame([], "probe_seq string, subject_id long, strand string, start int, mm int, alignment string")
    # a place may be found by both halves
    text = F.concat(F.lit("Query:  "), "probe_seq", F.lit("\nSubject: "), "w")
    return found.distinct().select("probe_seq", "subject_id", "strand", "start", "mm", text.alias("alignment"))


# ---- local alignments in a band


#: Fields of a packed score, in the order in which alignments of one score are preferred: fewer openings, fewer gap columns,
#: fewer mismatches, the earlier start in the probe, the lower diagonal there.
_OPENINGS, _COLUMNS, _MISMATCHES, _START, _DIAGONAL, _SCORE = 34, 26, 18, 6, 0, 40
_NEVER = np.int64(-(1 << 60))


def banded(probes: np.ndarray, lengths: np.ndarray, windows: np.ndarray, band: int, scores: Scores) -> dict[str, np.ndarray]:
    """The best local alignment of every probe (bytes, padded) in its window, which starts ``band`` bases before the
    middle diagonal: score, openings, gap columns, mismatches, ends in the probe and in the window.

    A cell holds one packed number: the score above the fields, each field subtracted, so the largest number is the best
    alignment and says how it was made."""
    n, size, width = len(probes), probes.shape[1], 2 * band + 1
    one = np.int64(1)
    hit = np.int64(scores.match) << _SCORE
    miss = (np.int64(scores.mismatch) << _SCORE) - (one << _MISMATCHES)
    column = (np.int64(-scores.column) << _SCORE) - (one << _COLUMNS)
    opening = (np.int64(-scores.opening) << _SCORE) - (one << _OPENINGS)
    outside = ord(OUTSIDE)
    none = np.full(n, _NEVER)
    paired, dropped, added = ([none] * width for _ in range(3))  # how the last column was made, for each diagonal
    best, best_at = none.copy(), np.zeros(n, np.int64)
    for i in range(size):
        now, lost, gained = [], [], []
        for j in range(width):
            letter = windows[:, i + j]
            step = np.where(probes[:, i] == letter, hit, miss)
            fresh = np.int64(-((i << _START) + j))
            before = np.maximum(np.maximum(paired[j], fresh), np.maximum(dropped[j], added[j]))
            cell = np.where((letter == outside) | (i >= lengths), _NEVER, before + step)
            now.append(cell)
            better = cell > best
            best = np.where(better, cell, best)
            best_at[better] = i * width + j
        for j in range(width):
            # a probe base without a partner: one diagonal down; a subject base without one: one up
            lost.append(np.maximum(paired[j + 1] + opening, dropped[j + 1]) + column if j + 1 < width else none)
            gained.append(np.maximum(now[j - 1] + opening, gained[j - 1]) + column if j else none)
        paired, dropped, added = now, lost, gained
    score = -((-best) >> _SCORE)
    rest = (score << _SCORE) - best
    field = lambda at, bits: (rest >> at) & ((1 << bits) - 1)
    start, diagonal = field(_START, 12), field(_DIAGONAL, 6)
    return {"score": score, "gapopen": field(_OPENINGS, 6), "gaps": field(_COLUMNS, 8), "mm": field(_MISMATCHES, 8), "q_start": start, "q_end": best_at // width + 1, "s_start": start + diagonal, "s_end": best_at // width + best_at % width + 1}


_ALIGNED = "probe_seq string, subject_id long, strand string, q_start int, q_end int, start int, end int, score int, columns int, matches int, mm int, gapopen int, gaps int"


#: Bases of the longest probe up to which the places of seeds carry the bases about them.
_CARRIED = 64


def _seeded(queries: DataFrame, subjects: DataFrame, seed: int, longest: int, band: int) -> DataFrame:
    """probe_seq, subject_id, strand, diagonal, probe_pos, w: the diagonals with a seed, and the subject from three bands before
    the diagonal to one behind the probe.  A row is a seed, found at ``probe_pos``; of long probes it is a diagonal, without one."""
    # written, as Spark then knows how many they are
    seeds = written(explode_kmers(queries, seed, "probe_seq", seq="probe_seq").select("probe_seq", "kmer", F.col("pos").alias("probe_pos")))
    size = F.length("probe_seq") + 4 * band
    if longest <= _CARRIED:
        reach = longest - seed + 3 * band
        kmer = F.substring("around", reach + 1, seed)
        places = seed_index(subjects, seed, reach).select("subject_id", "strand", "pos", "around", F.xxhash64(kmer).alias("code"))
        met = seeds.withColumn("code", F.xxhash64("kmer")).join(places, "code").filter(kmer == F.col("kmer"))
        window = F.substring("around", F.lit(reach - 3 * band + 1) - F.col("probe_pos"), size)
        return met.select("probe_seq", "subject_id", "strand", (F.col("pos") - F.col("probe_pos")).alias("diagonal"), "probe_pos", window.alias("w"))
    places = explode_kmers(subjects, seed, "subject_id", "strand").select("subject_id", "strand", "kmer", F.col("pos").alias("subject_pos"))
    diagonals = seeds.join(places, "kmer").select("probe_seq", "subject_id", "strand", (F.col("subject_pos") - F.col("probe_pos")).alias("diagonal")).distinct()
    pad = longest + 3 * band
    padded = subjects.select("subject_id", "strand", F.concat(F.lit(OUTSIDE * pad), "seq", F.lit(OUTSIDE * pad)).alias("seq"))
    pieces = blocks(padded, longest + 4 * band, "subject_id", "strand")
    at = F.col("diagonal") + (pad - 3 * band)
    placed = written(diagonals).withColumn("offset", at - F.pmod(at, F.lit(BLOCK)))
    window = F.substring("b", at - F.col("offset") + 1, size).cast("string")
    return placed.join(pieces, ["subject_id", "strand", "offset"]).select("probe_seq", "subject_id", "strand", "diagonal", F.lit(None).cast("int").alias("probe_pos"), window.alias("w"))


def _letters(texts: pa.Array, wide: int, fill: str) -> np.ndarray:
    """The bytes of texts, a row each, filled up behind."""
    flat = texts.cast(pa.large_binary())
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1]
    raw = np.frombuffer(flat.buffers()[2], np.uint8)
    step = np.arange(wide)
    return np.where(step < np.diff(at)[:, None], raw[np.minimum(at[:-1, None] + step, len(raw) - 1)], np.uint8(ord(fill)))


def _first_seed(probes: np.ndarray, lengths: np.ndarray, windows: np.ndarray, seed: int) -> np.ndarray:
    """Where the first exact seed of the probes starts on the diagonal that a window begins with; -1 without one."""
    size = probes.shape[1]
    same = (probes == windows[:, :size]) & (windows[:, :size] != ord(OUTSIDE)) & (np.arange(size) < lengths[:, None])
    since = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
    whole = since[:, seed:] - since[:, :-seed] == seed
    return np.where(whole.any(axis=1), whole.argmax(axis=1), -1)


def local(probes: DataFrame, subjects: DataFrame, seed: int = 10, band: int = 3, scores: Scores = Scores(), least: int | None = None) -> DataFrame:
    """probe_seq, subject_id, strand, q_start, q_end, start, end, score, columns, matches, mm, gapopen, gaps: the best local
    alignments about the diagonals with an exact ``seed``, of ``least`` or more.

    ``start`` and ``end`` are the subject's; columns are those of the alignment, gaps included.  A diagonal counts at its first
    seed, and an alignment that several diagonals lead to at the lowest of them: all of them lie within two bands, so a row tells
    by itself and what is found is not shuffled.  Probes have up to 4,095 bases, a band has up to 31."""
    least = seed * scores.match if least is None else least
    queries = written(probes.select("probe_seq").distinct().filter(F.length("probe_seq") >= seed))
    longest = queries.agg(F.max(F.length("probe_seq"))).first()[0] or seed
    if longest > 4095 or not 0 <= band <= 31:
        raise ValueError("a probe has up to 4,095 bases and a band up to 31")
    subjects = written(subjects.select("subject_id", "strand", "seq").filter("subject_id is not null and strand is not null"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            size = int(lengths.max())
            p, w = _letters(batch.column(0), size, " "), _letters(batch.column(5), size + 4 * band, OUTSIDE)
            on = lambda s: w[:, 3 * band - s :]  # noqa: E731, B023
            about = lambda s: w[:, 2 * band - s : 4 * band - s + size]  # noqa: E731, B023
            at = batch.column(4)
            keep = np.ones(len(p), bool) if at.null_count else _first_seed(p, lengths, on(0), seed) == np.asarray(at)
            found = banded(p, lengths, about(0), band, scores)
            keep &= found["score"] >= least
            for s in range(1, 2 * band + 1):
                rows = np.nonzero(keep & (_first_seed(p, lengths, on(s), seed) >= 0))[0]
                if len(rows):
                    lower = banded(p[rows], lengths[rows], about(s)[rows], band, scores)
                    again = np.ones(len(rows), bool)
                    for name, values in lower.items():
                        again &= values - s * name.startswith("s_") == found[name][rows]
                    keep[rows[again]] = False
            x = {name: values[keep] for name, values in found.items()}
            matches = (x["score"] - scores.mismatch * x["mm"] + scores.opening * x["gapopen"] + scores.column * x["gaps"]) // scores.match
            first = np.asarray(batch.column(3))[keep] - band
            values = [x["q_start"], x["q_end"], first + x["s_start"], first + x["s_end"], x["score"], matches + x["mm"] + x["gaps"], matches, x["mm"], x["gapopen"], x["gaps"]]
            kept = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(c.filter(kept) for c in batch.columns[:3]), *(pa.array(v.astype(np.int32)) for v in values)], names)

    names = [c.split()[0] for c in _ALIGNED.split(", ")]
    laid = _seeded(queries, subjects, seed, longest, band)
    out = laid.withColumn("subject_id", F.col("subject_id").cast("long")).withColumn("diagonal", F.col("diagonal").cast("long")).mapInArrow(align, _ALIGNED)
    # sequences that share an id may hold the same alignment
    shared = subjects.groupBy("subject_id", "strand").count().filter("count > 1")
    return out if shared.isEmpty() else out.distinct()


def gapped(probes: DataFrame, subjects: DataFrame, seed: int = 10, band: int = 3, identity: float = 0.8, scores: Scores = Scores()) -> DataFrame:
    """probe_seq, subject_id, strand, start, mm, mismatches, gapopen: local alignments with as many columns as the probe has
    bases, at the least identity.  ``mm`` counts mismatches and gap openings, so the histogram and the scores of sets of
    ``offtarget`` take these hits as they are."""
    found = local(probes, subjects, seed, band, scores)
    whole = found.filter((F.col("columns") == F.length("probe_seq")) & (F.col("matches") >= F.lit(identity) * F.col("columns") - 1e-9))
    return whole.select("probe_seq", "subject_id", "strand", "start", (F.col("mm") + F.col("gapopen")).alias("mm"), F.col("mm").alias("mismatches"), "gapopen")


def segments(probes: DataFrame, subjects: DataFrame, seed: int = 10, scores: Scores = Scores(), least: int | None = None) -> DataFrame:
    """The maximal-scoring segment of each diagonal with a seed, ungapped, of any length."""
    found = local(probes, subjects, seed, 0, scores, least)
    return found.select("probe_seq", "subject_id", "strand", "q_start", "q_end", "start", "end", "score", "mm")
