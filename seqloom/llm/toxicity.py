"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of ASCII letters, digits and bytes beyond ASCII.  The features of a text are the distinct
hashes (``BITS`` bits) of its words, of its pairs of neighbours and of its pairs one word apart; each counts 1, so a long
text is judged by what stands in it and not by its share.  A score is the logistic function of the bias and the
weights of the features that have one.

Training reads the labelled rows whose ``crc32(doc_id as text) % FOLDS`` is not 0, in the order of a hash of doc_id, until
``ROWS`` rows or ``FEATURES`` features are reached, and no more: a sample bounded in memory, taken in one task.  FTRL-proximal
keeps for every feature a sum of gradients and of their squares; a feature's rate falls with its own squares, and its weight is
0 until its gradients sum to more than ``L1``.  So a feature that ``EPOCHS`` readings of all its rows cannot lift above ``L1``
never gets a weight and is not laid out; what has one is at most ``FEATURES`` pairs of numbers, sent to all tasks.

Edge cases: a null or empty text has no features and gets the score of the bias; without usable labels every score is
0.5; labels other than 0 and 1 (and null) are not learned from; repeated rows and doc_ids are each scored, and doc_ids that
repeat among the labels are each learned from; a null doc_id has no label and is not held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .hashing import U, WordHashes, mix

FOLDS = 5
#: Bounds of the training sample.
ROWS, FEATURES = 8_192, 8_000_000
BITS = 40
#: Rates: ALPHA / (BETA + root of a feature's squared gradients); L1 and L2 of the weights; readings of the sample.
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 10.0, 0.0, 10
_GOLDEN, _NEXT, _SKIP = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)
_LETTERS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def features(text: bytes, cache: WordHashes) -> np.ndarray:
    """Hashes of a text's words, neighbours and pairs one word apart; repeated ones too."""
    w = cache.of(text.translate(_LETTERS).split())
    return np.concatenate([w, mix(w[:-1] * _GOLDEN + w[1:] * _NEXT), mix(w[:-2] * _GOLDEN + w[2:] * _SKIP)]) >> U(64 - BITS)


@dataclass
class Weights:
    """A bias and the features with a weight, in order."""

    bias: float
    hashes: np.ndarray
    values: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        """The sum of the bias and of the weights of the distinct features."""
        if not len(self.hashes):
            return self.bias
        at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
        at = np.unique(at[self.hashes[at] == found])
        return self.bias + float(self.values[at].sum())


def train(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over rows of distinct features, in their order, ``epochs`` times."""
    if not rows:
        return Weights(0.0, np.empty(0, U), np.empty(0))
    hashes, place, counts = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    kept = counts * epochs > L1
    at = np.where(kept, np.cumsum(kept) - 1, -1)[place]
    parts = [p[p >= 0] for p in np.split(at, np.cumsum([len(r) for r in rows])[:-1])]
    hashes = hashes[kept]
    z, n, w = (np.zeros(len(hashes)) for _ in range(3))
    bias = bias_z = bias_n = 0.0
    for _ in range(epochs):
        for x, y in zip(parts, labels, strict=True):
            g = _logistic(bias + w[x].sum()) - y
            # the bias has no penalty
            sigma = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_z, bias_n = bias_z + g - sigma * bias, bias_n + g * g
            bias = -bias_z * ALPHA / (BETA + np.sqrt(bias_n))
            was = n[x]
            now = was + g * g
            root = np.sqrt(now)
            zx = z[x] + g - (root - np.sqrt(was)) / ALPHA * w[x]
            z[x], n[x] = zx, now
            w[x] = np.where(np.abs(zx) > L1, (np.sign(zx) * L1 - zx) / ((BETA + root) / ALPHA + L2), 0.0)
    some = w != 0
    return Weights(float(bias), hashes[some], w[some])


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -500.0), 500.0))))


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _laid(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """key, label, n, features of the labelled rows of the sample, whole."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # at most ``rows`` pairs of numbers
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(rows)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            found = [np.unique(features(t.as_py(), cache)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "label", "n", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(lay, "doc_id long, label int, n long, features binary")


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, most: int = FEATURES) -> Weights:
    """Weights learned from the sample."""
    laid = cut(_laid(docs, labels, rows))
    by = [F.xxhash64("doc_id"), "doc_id", "label", "n", F.xxhash64("features")]
    before = F.sum("n").over(Window.partitionBy("whole").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    ranked = laid.withColumn("whole", F.lit(0)).withColumn("rank", F.row_number().over(Window.partitionBy("whole").orderBy(*by)))
    sample = ranked.withColumn("sum", before).filter((F.col("rank") <= rows) & ((F.col("sum") <= most) | (F.col("rank") == 1)))

    def learn(block: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(block.column("rank")))
        found, y = block.column("features"), np.asarray(block.column("label"))
        weights = train([np.frombuffer(found[int(k)].as_py(), U) for k in order], y[order].tolist())
        return pa.table([pa.array(np.append(np.int64(-1), weights.hashes.astype(np.int64))), pa.array(np.append(weights.bias, weights.values))], ["hash", "weight"])

    out = sample.select("whole", "rank", "label", "features").groupBy("whole").applyInArrow(learn, "hash long, weight double").toArrow()
    hashes, values = np.asarray(out.column("hash")), np.asarray(out.column("weight"))
    if not len(hashes):
        return train([], [])
    return Weights(float(values[hashes < 0][0]), hashes[hashes >= 0].astype(U), values[hashes >= 0])


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, w = WordHashes(), sent.value
        for batch in batches:
            scores = [_logistic(w.margin(features(t.as_py(), cache))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    out = texts.mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by weights learned from the labels."""
    return score(docs, fit(docs, labels))
