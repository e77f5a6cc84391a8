"""Benchmark decontamination as a prefix-filtered set join.

Words are maximal runs of 0-9, a-z and bytes from 0x80 up, A-Z lower-cased.  A window is
``WINDOW`` consecutive words of an item; an item of fewer words is one window.  All
words of a window must occur, so its prefix is its rarest word alone: document
frequencies of the benchmark's words come from the whole corpus, and only
positions that hold the rarest word of some window are joined.  Length bound: the text
has room for a window.  Positional bound: the word's place in the window fixes
where the window would start, and it must lie inside the text.  Candidates are
verified word by word.

Tasks keep bit maps of the benchmark's words, of the prefix words and of the words next to them, ``BITS_A_WORD`` bits
for each distinct word of the benchmark, within ``LEAST_BITS`` and ``MOST_BITS`` (32 MB); what passes by
chance falls out in the joins, which Spark may broadcast or split by size.

Edge cases: a null text, or one without words, has no words, no hits and is clean; items
without words are ignored; items with equal windows all count; an item with a null item_id hits and contaminates, but
is not among the items; every row is returned, rows that share a doc_id each with its own text; a null doc_id stays null;
an empty benchmark leaves every text clean; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, own_id, row_id

WINDOW = 13
BITS_A_WORD, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
#: Words around a prefix word that tasks look up as well, against prefixes that are common words.
GRAM = 4
#: A-Z lower-cased, 0-9, a-z and bytes from 0x80 up as they are, all others space.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class _Known(dict):
    """word -> whether the bit map may hold it, remembered."""

    def __init__(self, bits: bytes):
        self.bits, self.size = bits, 8 * len(bits)

    def __missing__(self, word: bytes) -> bool:
        if len(self) > 300_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word) % self.size
        hit = self[word] = bool(self.bits[h >> 3] >> (h & 7) & 1)
        return hit


def _gram(words: list[bytes], place: int) -> bytes:
    """The ``GRAM`` words of a window (or all of them) that hold its prefix word, as early as they can lie."""
    start = max(0, min(place, len(words) - GRAM))
    return b" ".join(words[start : start + GRAM])


def map_size(n: int) -> int:
    """Bits of a map of the words of a benchmark of n distinct words: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_WORD * n).bit_length()))


def _bit_map(rows: DataFrame, size: int, key=lambda word: word) -> bytes:
    """Bits of ``key(*columns)`` over some rows."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            seen.update(xxhash.xxh3_64_intdigest(key(*x)) % size for x in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int32())], ["bit"])

    # at most ``size`` distinct bits
    place = rows.mapInArrow(bits, "bit int").groupBy((F.col("bit") / 4096).cast("int").alias("page")).agg(F.collect_set("bit").alias("bits"))
    out = np.zeros(size, np.uint8)
    for row in place.toLocalIterator():
        out[row["bits"]] = 1
    return np.packbits(out, bitorder="little").tobytes()


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words (array of binary) of every window of every item."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ws = words_of(text)
                found = {tuple(ws[i : i + window]) for i in range(max(1, len(ws) - window + 1))} if ws else ()
                for x in sorted(found):
                    ids.append(item)
                    out.append(list(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.list_(pa.binary()))], ["item_id", "words"])

    items = benchmark.filter("text is not null").select(F.col("item_id").cast("string"), F.col("text").cast("binary"))
    return items.mapInArrow(split, "item_id string, words array<binary>")


def word_frequencies(rows: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """word, df: documents that hold it, for the words of ``vocabulary`` (word)."""
    known = rows.sparkSession.sparkContext.broadcast(_bit_map(vocabulary, size))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_word, total = _Known(known.value), {}
        for batch in batches:
            for text in batch.column(0):
                for w in set(words_of(text.as_py())):
                    if known_word[w]:
                        total[w] = total.get(w, 0) + 1
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = rows.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("df"))
    return vocabulary.join(counted, "word", "left").select("word", F.coalesce("df", F.lit(0)).alias("df"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated
    (some word is hit and ``share * n_hit >= n_words``)."""
    each = judged(docs, benchmark, window, share)
    # equal rows were judged together
    return each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select(own_id(), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def text_print(text: str = "text") -> Column:
    """Names a text among the rows that share a doc_id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The same per doc_id (:func:`row_id`) and ``row`` (:func:`text_print`), with the number of ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row_id().alias("doc_id"), text_print().alias("row"), text.cast("binary").alias("text"), F.monotonically_increasing_id().alias("number"))
    windows = cut(item_windows(benchmark, window).groupBy("words").agg(F.collect_set("item_id").alias("items")))
    vocabulary = cut(windows.select(F.explode("words").alias("word")).distinct())
    size = map_size(vocabulary.count())
    frequency = cut(word_frequencies(rows, vocabulary, size))
    # the prefix: the rarest word, the earliest place of it
    placed = windows.select("words", "items", F.posexplode("words").alias("place", "word")).join(frequency, "word")
    prefix = cut(placed.groupBy("words").agg(F.min_by(F.struct("word", "place"), F.struct("df", "word", "place")).alias("p"), F.first("items").alias("items")).select("p.word", "p.place", "words", "items"))
    known = docs.sparkSession.sparkContext.broadcast(_bit_map(prefix.select("word").distinct(), size))
    grams = docs.sparkSession.sparkContext.broadcast(_bit_map(prefix.select("words", "place"), size, _gram))
    sizes = sorted(r[0] for r in prefix.select(F.least(F.size("words"), F.lit(GRAM))).distinct().collect())  # of 1 to GRAM

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per text: n_words and its places that may start a prefix, each with the words around it."""
        known_word, known_gram = _Known(known.value), _Known(grams.value)
        near = lambda ws, i: any(known_gram[b" ".join(ws[a : a + g])] for g in sizes for a in range(max(0, i - g + 1), i + 1))
        for batch in batches:
            n_words, found = [], []
            for text in batch.column(2):
                ws = words_of(text.as_py())
                n_words.append(len(ws))
                hits = [i for i, hit in enumerate(map(known_word.__getitem__, ws)) if hit and near(ws, i)]
                found.append([{"word": ws[i], "at": i, "left": b" ".join(ws[max(0, i - window + 1) : i]), "right": b" ".join(ws[i : i + window])} for i in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n_words, pa.int64()), pa.array(found, pa.list_(around))], ["doc_id", "row", "number", "n_words", "found"])

    around = pa.struct([("word", pa.binary()), ("at", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
    spread = rows.mapInArrow(candidates, "doc_id long, row long, number long, n_words long, found array<struct<word: binary, at: long, left: binary, right: binary>>")
    # texts without candidates get a key of their own, so that no task collects them
    each = spread.select("doc_id", "row", "number", "n_words", F.explode_outer("found").alias("c")).select("doc_id", "row", "number", "n_words", F.coalesce("c.word", F.concat(F.lit(b"\0"), F.col("row").cast("string").cast("binary"))).alias("word"), F.col("c.at").alias("at"), F.col("c.left").alias("left"), F.col("c.right").alias("right"))
    join_words = lambda w: F.array_join(F.transform(w, lambda x: F.hex(x)), "20")
    before = join_words(F.slice("words", F.lit(1), F.col("place")))
    after = join_words(F.slice("words", F.col("place") + 1, F.size("words")))
    keyed = prefix.select("word", F.col("place"), F.size("words").alias("length"), before.alias("before"), after.alias("after"), "items")
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("length") <= F.col("n_words"))
    left, right = F.concat(F.lit("20"), F.hex("left")), F.concat(F.hex("right"), F.lit("20"))
    equal = ((F.col("place") == 0) | F.endswith(left, F.concat(F.lit("20"), F.col("before")))) & F.startswith(right, F.concat(F.col("after"), F.lit("20")))
    hit = F.when(fits & equal, F.struct(start.alias("start"), (start + F.col("length")).alias("end")))
    joined = each.join(keyed, "word", "left").withColumn("hit", hit).withColumn("hit_items", F.when(F.col("hit").isNotNull(), F.col("items")))
    per = joined.groupBy("doc_id", "row").agg(F.size(F.collect_set("number")).alias("rows"), F.first("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("hit_items")))).alias("items"))
    grown = lambda a, h: F.struct((a["n"] + F.greatest(h["end"] - F.greatest(h["start"], a["end"]), F.lit(0))).alias("n"), F.greatest(h["end"], a["end"]).alias("end"))
    zero = F.lit(0).cast("long")
    n_hit = F.aggregate("hits", F.struct(zero.alias("n"), zero.alias("end")), grown, lambda a: a["n"])
    return per.withColumn("n_hit", n_hit).select("doc_id", "row", "rows", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
