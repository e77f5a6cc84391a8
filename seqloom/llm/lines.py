"""Line dedup: explode normalised lines, hash them, count documents per hash, drop, reassemble.

Texts are split at ``\\n``; a line's key is the line without 0x20, 0x09-0x0D at
its ends, A-Z lower-cased.  Keys of ``min_chars`` code points or more found in
``min_docs`` documents or more lose their lines everywhere but in the largest
doc_id that holds them.

Only (128-bit hash, row, line number) is shuffled for the counts; a hash that a
third of all documents share is summed per document and map-side first, and its
join is an equi-join of rows that Spark may split.  Line numbers to drop meet
the text again by row, so every text crosses one shuffle.

Edge cases: a null or empty text is one empty line and stays; a null doc_id
counts as one document below all others; rows that share a doc_id are one
document for the counts, and each of them is returned with its own text; no
rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_id, row_id

_BLANK = b" \t\n\r\x0b\x0c"


def _keyed_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(row_id().alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))


def line_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, pos, h1, h2 of every line whose key is long enough."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, pos, hashes = [], [], [], []
            for doc, row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, line in enumerate(text.split(b"\n")):
                    key = line.strip(_BLANK)
                    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
                        continue
                    ids.append(doc)
                    rows.append(row)
                    pos.append(i)
                    hashes.append(xxhash.xxh3_128_intdigest(key.lower()))
            signed = lambda values: pa.array([v - (1 << 64) if v >> 63 else v for v in values], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(pos, pa.int32()), signed([h >> 64 for h in hashes]), signed([h & (1 << 64) - 1 for h in hashes])], ["doc_id", "row", "pos", "h1", "h2"])

    return _keyed_rows(docs).mapInArrow(explode, "doc_id long, row long, pos int, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, the kept text."""
    lines = cut(line_keys(docs, min_chars))
    # written, so that both sides of the join below are dealt for it alone and a common line's rows can be split
    common = cut(lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("holder")).filter(F.col("n") >= min_docs).drop("n"))
    dropped = lines.join(common, ["h1", "h2"]).filter("doc_id < holder").groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop"))
    rows = _keyed_rows(docs).join(dropped, ["doc_id", "row"], "left").select("doc_id", "text", "drop")

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, shas, texts = [], [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                split = text.split(b"\n")
                if drop:
                    gone = set(drop)
                    text = b"\n".join([x for i, x in enumerate(split) if i not in gone])
                n_lines.append(len(split))
                n_dropped.append(len(drop or ()))
                shas.append(hashlib.sha256(text).hexdigest())
                texts.append(text)
            out = [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(shas, pa.string())]
            if with_text:
                out.append(pa.array(texts, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["doc_id", "n_lines", "n_dropped", "kept_sha256", *["text"] * with_text]
    out = rows.mapInArrow(reassemble, "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", text binary" * with_text)
    kept = [F.col("text").cast("string").alias("text")] * with_text
    return out.select(own_id(), "n_lines", "n_dropped", "kept_sha256", *kept)
