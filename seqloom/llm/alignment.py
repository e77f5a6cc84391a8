"""Alignment of two tokenizers' ids over a corpus, counted in id-striped dense matrices.

A text is cut before each space that follows a character other than white space.  Neither tokenizer has a token across
such a place, so all of a chunk's tokens, groups (runs of bytes between offsets where tokens of both end) and links (the
two tokens that end a group) are worked out once and remembered; a text is a list of chunks.

1. Tasks write, for each portion of texts and each stripe (side-B id modulo ``STRIPES``), one record: the id
   pairs that are linked, how often, in which texts of the portion and how often there; and one record of the texts' own figures.
2. Counts are added with ``np.add.at`` into the dense block of a stripe (its side-B ids by all side-A ids), first for the
   portions of a cell (stripe, portion modulo the number of cells), then for the stripe; a row's maximum is a side-B id's best.
3. The links are dealt by cell as well, behind the counts of their stripe, and scored there: two numbers a text, side by
   side in one record for each (portion, stripe).  The records of a portion are added up.

A task holds one stripe's block, a portion's record or the records of one portion; the cells grow in number with the
portions.  Chunks longer than ``LONG`` characters are not remembered.

Edge cases: a text that is null or empty, or that a tokenizer does not give back byte for byte (side B turns U+2581 into a
space), has zeros and '' for its print; repeated rows and doc_ids are each counted and returned; null doc_ids stay
null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .hashing import from_planes, planes

FOLDER = "/opt/tokenizers"
SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A stripe's dense block has 1 / STRIPES of the side-B ids: 100 MB for 32,000 by 50,257.
STRIPES = 128
#: Portions of texts: so many chunks (a longer text is a portion alone) and texts at most.  Portions of a cell.
CHUNKS, TEXTS, CELL = 250_000, 60_000, 256
#: Chunks that a task remembers, and the longest.
CACHED, LONG = 300_000, 64
#: The splitting rule of byte-level BPE, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CUT = re.compile(r"(?<=\S) ").split
#: White space that may stand before a space; all of it beyond ASCII, too.
_WHITE = [chr(c) + " " for c in range(0x3001) if chr(c).isspace()]
_WHITE_ASCII = [w for w in _WHITE if w.isascii()]
_RECORD = "portion long, stripe int, texts int, pairs binary, totals binary, holders binary, owners binary, times binary, figures binary, prints binary"
_COLUMNS = [c.split()[0] for c in _RECORD.split(", ")]
#: The stripe of a portion's own figures.
_OWN = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def _chunks(text: str) -> list[str]:
    """A text cut before each space that follows a character other than white space."""
    if text[0] == " " or any(w in text for w in (_WHITE_ASCII if text.isascii() else _WHITE)):
        return _CUT(text)
    return text.split(" ")


class Tokenizers:
    """Both tokenizers, from the contents of their files."""

    def __init__(self, side_a: bytes, side_b: bytes) -> None:
        model, letters = json.loads(side_a)["model"], byte_letters()
        ids = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        ids = {token: i for token, i in ids.items() if len(token) == 1} | {token: ids[token] for token in (self._merged(m, letters) for m in model["merges"])}
        ranks = [ids[self._merged(m, letters)] for m in model["merges"]]
        if any(a >= b for a, b in zip(ranks, ranks[1:], strict=False)):
            raise ValueError("merges of side A do not follow its ids")
        self.a = tiktoken.Encoding("side_a", pat_str=PATTERN, mergeable_ranks=ids, special_tokens={})
        self.size_a = 1 + max(model["vocab"].values())
        self.bytes_a = np.full(self.size_a, b"", object)
        for token, i in ids.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=side_b)
        self.size_b = self.b.get_piece_size()
        self.bytes_b = np.full(self.size_b, b"", object)
        self.space = self.b.piece_to_id("▁")
        for i in range(self.size_b):
            piece = self.b.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError("a piece of side B crosses a space")
            self.bytes_b[i] = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
        if self.size_a > 1 << 16 or self.size_b > STRIPES << 16:
            raise ValueError("more ids than a pair holds")
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        # decimal ids as they stand in a print: inside and at the end of a group's side; side B's at a chunk's end
        self.said_a = np.array([f"{i}{end}" for end in ",|" for i in range(self.size_a)], object)
        self.said_b = np.array([f"{i}{end}" for end in ",;\n" for i in range(self.size_b)], object)

    @staticmethod
    def _merged(merge: str | list[str], letters: dict[str, int]) -> bytes:
        return bytes(letters[c] for c in "".join(merge.split(" ") if isinstance(merge, str) else merge))

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers of ids on both sides of each chunk, with the space before it."""
        b = self.b.encode(chunks, num_threads=1)
        for k in np.flatnonzero([not c for c in chunks]).tolist():
            b[k] = [self.space]
        # side A reads chunks in one text where none ends in white space
        if any(c[-1:].isspace() or not c for c in chunks):
            a = [self.a.encode_ordinary(" " + c) for c in chunks]
            ids_a, count_a = np.fromiter(chain.from_iterable(a), np.int64), np.array([len(x) for x in a])
        else:
            ids_a = np.array(self.a.encode_ordinary(" " + " ".join(chunks)), np.int64)
            ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
            count_a = np.diff(np.searchsorted(np.cumsum(self.width_a[ids_a]), ends, side="right"), prepend=0)
        return ids_a, count_a, np.fromiter(chain.from_iterable(b), np.int64), np.array([len(x) for x in b])


class _Numbers(dict):
    """chunk -> number, given out as chunks come."""

    def __init__(self) -> None:
        self.new: list[str] = []
        self.next = 0

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = self.next
        self.next += 1
        self.new.append(chunk)
        return n


class Chunks:
    """Chunks that have been worked out: their numbers of tokens and groups, prints and links (side-B id * size_a + side-A id)."""

    def __init__(self, tokenizers: Tokenizers) -> None:
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.number, self.said, self.bad = _Numbers(), [], set()
        self.figures = np.empty((0, 3), np.int64)
        self.links, self.bounds = np.empty(0, np.int64), np.zeros(1, np.int64)

    def learn(self, chunks: list[str]) -> None:
        """Work out new chunks, together."""
        t = self.t
        a, na, b, nb = t.encode(chunks)
        raw = [(" " + c).encode() for c in chunks]
        size, keep = np.array([len(r) for r in raw]), np.ones(len(chunks), bool)
        text_a, text_b, text = b"".join(t.bytes_a[a].tolist()), b"".join(t.bytes_b[b].tolist()), b"".join(raw)
        at = [np.cumsum(np.bincount(np.repeat(np.arange(len(chunks)), n), w[x], len(chunks)).astype(np.int64)) for n, w, x in ((na, t.width_a, a), (nb, t.width_b, b))]
        if not (text_a == text_b == text and all((x == np.cumsum(size)).all() for x in at)):
            from_a = from_b = 0
            for k, (r, ea, eb) in enumerate(zip(raw, at[0].tolist(), at[1].tolist(), strict=True)):
                keep[k] = r == text_a[from_a:ea] == text_b[from_b:eb]
                from_a, from_b = ea, eb
            self.bad.update((len(self.said) + np.flatnonzero(~keep)).tolist())
            a, b = a[np.repeat(keep, na)], b[np.repeat(keep, nb)]
        first = np.cumsum(np.append(0, size * keep))
        end_a, end_b = np.cumsum(t.width_a[a]), np.cumsum(t.width_b[b])
        ends, of_a, of_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        # tokens in the order of the print: group by group, side A before side B
        size_a, size_b = np.diff(of_a, prepend=-1), np.diff(of_b, prepend=-1)
        said = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[of_a] = last_b[of_b] = 1
        last_b[np.flatnonzero(np.isin(end_b, first))] = 2
        said[np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)] = t.said_a[a + last_a * t.size_a]
        said[np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)] = t.said_b[b + last_b * t.size_b]
        listed = iter("".join(said.tolist()).split("\n"))
        self.said += [next(listed) if k else "" for k in keep.tolist()]
        groups = np.diff(np.searchsorted(ends, first, side="right"))
        self.figures = np.concatenate([self.figures, np.stack([na * keep, nb * keep, groups], axis=1)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(groups)])
        self.links = np.concatenate([self.links, b[of_b] * t.size_a + a[of_a]])
        self.number.next = len(self.said)

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """The chunks of each text, as numbers; null, empty and unsound texts have none."""
        if len(self.said) > CACHED or len(self.links) > 10 * CACHED:
            self.clear()
        number = self.number
        out = [np.fromiter(map(number.__getitem__, _chunks(x)), np.int64) if x else np.empty(0, np.int64) for x in texts]
        new, number.new = number.new, []
        if new:
            self.learn(new)
        if self.bad:
            # what two chunks lack together may yet be a whole: such a text is one chunk
            for i, x in enumerate(out):
                if not self.bad.isdisjoint(x.tolist()):
                    self.learn([texts[i]])
                    last = len(self.said) - 1
                    out[i] = np.arange(last, last if last in self.bad else last + 1)
        for c in new:
            if len(c) > LONG:
                del number[c]
        return out


@lru_cache(maxsize=1)
def _known(side_a: bytes, side_b: bytes) -> Chunks:
    """What a worker knows of two tokenizers, from task to task."""
    return Chunks(Tokenizers(side_a, side_b))


def _portion(chunks: Chunks, texts: list[str | None], ids: list[int | None], portion: int) -> Iterator[list]:
    """The records of some texts: their own figures, and one for each stripe that they have links in."""
    numbers = chunks.of(texts)
    figures = chunks.figures
    own = np.zeros((4, len(texts)), np.int64)
    prints, laid, owner = bytearray(32 * len(texts)), [], []
    for i, x in enumerate(numbers):
        if len(x):
            own[1:, i] = figures[x].sum(axis=0)
            prints[32 * i : 32 * i + 32] = hashlib.sha256(";".join([chunks.said[k] for k in x.tolist()]).encode()).digest()
            laid.append(x)
            owner.append(i)
    own[0] = [0 if x is None else x for x in ids]
    known = np.array([x is not None for x in ids], np.uint8)
    yield [portion, _OWN, len(texts), None, None, None, known.tobytes(), None, planes(own.ravel()), bytes(prints)]
    if not laid:
        return
    at = np.concatenate(laid)
    count = figures[at, 2]
    doc = np.repeat(np.repeat(np.array(owner), [len(x) for x in laid]), count)
    start = chunks.bounds[at]
    links = chunks.links[np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    size_a = chunks.t.size_a
    b = links // size_a
    # by stripe, pair and text
    key = ((b % STRIPES) << 48) | ((b // STRIPES) << 32) | ((links - b * size_a) << 16) | doc
    key, times = np.unique(key, return_counts=True)
    pair = key >> 16
    heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    totals = np.add.reduceat(times, heads)
    holders = np.diff(np.append(heads, len(key)))
    stripe = pair[heads] >> 32
    bounds = np.append(np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])), len(stripe))
    ends = np.append(heads, len(key))
    for p, q in zip(bounds[:-1], bounds[1:], strict=True):
        e = slice(ends[p], ends[q])
        yield [portion, int(stripe[p]), len(texts), planes((pair[heads[p:q]] & 0xFFFFFFFF).astype(np.uint32)), planes(totals[p:q].astype(np.uint32)), planes(holders[p:q].astype(np.uint16)), planes((key[e] & 0xFFFF).astype(np.uint16)), planes(times[e].astype(np.uint32)), None, None]


def _table(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _COLUMNS)


def _records(docs: DataFrame, files) -> DataFrame:
    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, portion = _known(*files.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            texts, ids, size = [], [], 0
            column = batch.column(1)
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                text = column[i].as_py()
                texts.append(text)
                ids.append(doc_id)
                size += text.count(" ") + 1 if text else 0
                if size >= CHUNKS or len(texts) >= TEXTS or i == batch.num_rows - 1:
                    yield _table(list(_portion(chunks, texts, ids, portion)))
                    portion += 1
                    texts, ids, size = [], [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(records, _RECORD)


class Block:
    """The dense counts of a stripe: side-B ids of the stripe by side-A ids."""

    def __init__(self, size_a: int, size_b: int) -> None:
        self.rows, self.size_a = -(-size_b // STRIPES), size_a
        self.cells = np.zeros(self.rows * size_a, np.int64)

    def places(self, pairs: np.ndarray) -> np.ndarray:
        """A pair is row << 16 | side-A id."""
        return (pairs >> 16).astype(np.int64) * self.size_a + (pairs & 0xFFFF)

    def best(self) -> np.ndarray:
        return self.cells.reshape(self.rows, self.size_a).max(axis=1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.cells)
        return ((at // self.size_a) << 16 | at % self.size_a).astype(np.uint32), self.cells[at]


def _added(parts: DataFrame, keys: list[str], sizes: tuple[int, int], width: type) -> DataFrame:
    """The pairs and totals of parts (stripe, cell, pairs, totals) added up by ``keys``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key = Block(*sizes), None

        def out() -> pa.RecordBatch:
            pairs, totals = block.pairs()
            block.cells[block.places(pairs)] = 0
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[-1] if len(key) > 1 else 0], pa.int32()), pa.array([planes(pairs)], pa.binary()), pa.array([planes(totals)], pa.binary())], ["stripe", "cell", "pairs", "totals"])

        for batch in batches:
            for stripe, cell, pairs, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = (stripe, cell)[: len(keys)]
                if key is not None and now != key:
                    yield out()
                key = now
                np.add.at(block.cells, block.places(from_planes(pairs, np.uint32)), from_planes(totals, width).astype(np.int64))
        if key is not None:
            yield out()

    dealt = parts.select("stripe", "cell", "pairs", "totals").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(add, "stripe int, cell int, pairs binary, totals binary")


def _scored(links: DataFrame, counts: DataFrame, cells: int, sizes: tuple[int, int]) -> DataFrame:
    """portion, scores (n_best of every text of the portion, then count_sum) of each record of links."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best, held = Block(*sizes), None, None
        for batch in batches:
            portions, scores = [], []
            for _, _, first, portion, texts, pairs, totals, holders, owners, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places = block.places(from_planes(pairs, np.uint32))
                if first == 0:
                    if held is not None:
                        block.cells[held] = 0
                    block.cells[places], held = from_planes(totals, np.int64), places
                    best = block.best()
                    continue
                count = block.cells[places]
                top = count == best[places // block.size_a]
                holders, owners, times = from_planes(holders, np.uint16), from_planes(owners, np.uint16), from_planes(times, np.uint32).astype(np.int64)
                out = np.zeros((2, texts), np.int64)
                np.add.at(out[0], owners, np.repeat(top, holders) * times)
                np.add.at(out[1], owners, np.repeat(count, holders) * times)
                portions.append(portion)
                scores.append(planes(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(portions, pa.int64()), pa.array(scores, pa.binary())], ["portion", "scores"])

    none = lambda t: F.lit(None).cast(t)
    ahead = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(0).alias("first"), none("long").alias("portion"), none("int").alias("texts"), "pairs", "totals", *[none("binary").alias(c) for c in ("holders", "owners", "times")])
    behind = links.select("stripe", "cell", F.lit(1).alias("first"), "portion", "texts", "pairs", none("binary").alias("totals"), "holders", "owners", "times")
    dealt = ahead.union(behind).repartition("stripe", "cell").sortWithinPartitions("stripe", "cell", "first")
    return dealt.mapInArrow(score, "portion long, scores binary")


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _texts(block: pa.Table) -> pa.Table:
    """One row for each text of a portion, from its own figures and its scores in all stripes."""
    scores = None
    for texts, figures, known, prints, part in zip(*(block.column(c).to_pylist() for c in ("texts", "figures", "owners", "prints", "scores")), strict=True):
        if part is None:
            n, own, ids, shas = texts, from_planes(figures, np.int64).reshape(4, texts), np.frombuffer(known, bool), prints
        else:
            part = from_planes(part, np.int64)
            scores = part if scores is None else scores + part
    scores = (np.zeros(2 * n, np.int64) if scores is None else scores).reshape(2, n)
    groups = own[3]
    said = [shas[32 * i : 32 * i + 32].hex() if groups[i] else "" for i in range(n)]
    return pa.table([pa.array(own[0], mask=~ids), *(pa.array(x) for x in (own[1], own[2], groups, groups, scores[0], scores[1])), pa.array(said, pa.string())], ["doc_id", *_NUMBERS, "groups_sha256"])


def _files(spark, folder: str, side_a: str, side_b: str):
    """The contents of both files, broadcast: a vocabulary's size."""
    out = []
    for name in (side_a, side_b):
        with open(f"{folder}/{name}", "rb") as f:
            out.append(f.read())
    return spark.sparkContext.broadcast(tuple(out)), Tokenizers(*out)


def align(docs: DataFrame, folder: str = FOLDER, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """Per row: doc_id, the numbers of tokens, groups and links, of links that are the best of their side-B id, the sum
    of its links' counts, and a print of its groups."""
    files, tokenizers = _files(docs.sparkSession, folder, side_a, side_b)
    sizes = tokenizers.size_a, tokenizers.size_b
    records = cut(_records(docs, files))
    cells = max(1, -(-records.filter(F.col("stripe") == _OWN).count() // CELL))
    links = records.filter(F.col("stripe") != _OWN).withColumn("cell", F.pmod(F.xxhash64("portion"), F.lit(cells)).cast("int"))
    counts = cut(_added(_added(links, ["stripe", "cell"], sizes, np.uint32), ["stripe"], sizes, np.int64))
    scores = _scored(links, counts, cells, sizes).select("portion", *[F.lit(None).cast(t).alias(c) for c, t in (("texts", "int"), ("figures", "binary"), ("owners", "binary"), ("prints", "binary"))], "scores")
    own = records.filter(F.col("stripe") == _OWN).select("portion", "texts", "figures", "owners", "prints", F.lit(None).cast("binary").alias("scores"))
    return own.union(scores).groupBy("portion").applyInArrow(_texts, ", ".join(["doc_id long", *[f"{c} long" for c in _NUMBERS], "groups_sha256 string"]))


def pair_counts(docs: DataFrame, folder: str = FOLDER, side_a: str = SIDE_A, side_b: str = SIDE_B) -> DataFrame:
    """id_b, id_a, count of every linked pair of ids, and whether it is the best of id_b."""
    files, tokenizers = _files(docs.sparkSession, folder, side_a, side_b)
    sizes = tokenizers.size_a, tokenizers.size_b
    links = _records(docs, files).filter(F.col("stripe") != _OWN).withColumn("cell", F.lit(0))
    added = _added(links, ["stripe"], sizes, np.uint32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, _, pairs, totals in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, totals = from_planes(pairs, np.uint32).astype(np.int64), from_planes(totals, np.int64)
                top = np.zeros(1 + int((pairs >> 16).max()), np.int64)
                np.maximum.at(top, pairs >> 16, totals)
                yield pa.RecordBatch.from_arrays([pa.array((pairs >> 16) * STRIPES + stripe), pa.array(pairs & 0xFFFF), pa.array(totals), pa.array(totals == top[pairs >> 16])], ["id_b", "id_a", "count", "best"])

    return added.mapInArrow(rows, "id_b long, id_a long, count long, best boolean")
