"""Periodic runs of words by a suffix automaton with merged end-position sets.

A run is a stretch of consecutive words whose smallest period is ``q`` (words ``q`` apart are identical), of
``max(LEAST, REPEATS * q)`` words or more, that no neighbouring word extends.

1. A text is cut down to the stretches whose every window of ``PROBE`` words occurs twice in the text.  Nothing is lost:
   in a run each such window recurs ``q`` words on or back, as a run has at least ``2 * q + PROBE`` words.  Stretches shorter
   than ``LEAST`` go.
2. A stretch is read into a suffix automaton.  States are visited from the longest down; each hands its ordered set of
   end positions to its suffix link, the smaller set being inserted in the larger.
3. An end position that is new in a state makes new neighbours.  Two neighbours ``d`` words apart in a state of length
   ``n >= d`` seed a square of period ``d``; as no end position lies between them, ``d`` is the smallest period there.  A run
   is seeded by the state of its words but the last ``q``, with ``n >= 2 * q`` and ``n + q >= LEAST``; so states shorter
   than ``LEAST - LEAST // REPEATS`` words are not visited, and weaker squares not followed.
4. A seed whose left end cannot move is extended to the right, once for each (start, period).

Words of a run behind its first ``q`` are dropped; runs are found on the text as it is, not on what is left.

Edge cases: a null or empty text has no words and no runs; repeated rows and doc_ids are judged each for
itself; other columns are ignored; no rows give no rows.  A task holds one text's stretch at a time; end-position
sets are cut in blocks, so that a long text of one word costs no quadratic shifting.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U, WordHashes, mix, window_hashes

LEAST, REPEATS = 24, 3
#: Words of the windows that must recur; LEAST >= 2 * q + PROBE where 3 * q <= LEAST, and q >= PROBE beyond.
PROBE = LEAST // REPEATS
#: Words that a task lays out in arrays at once (a longer text is laid out alone).
CHUNK = 125_000
_GOLDEN = U(0x9E3779B97F4A7C15)


class EndPositions:
    """An ordered set of numbers in blocks."""

    BLOCK = 1024
    __slots__ = ("blocks", "size", "tops")

    def __init__(self, x: int) -> None:
        self.blocks, self.tops, self.size = [[x]], [x], 1

    def add(self, x: int) -> None:
        i = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[i]
        insort(block, x)
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[i : i + 1] = [block[:half], block[half:]]
            self.tops[i : i + 1] = [block[half - 1], block[-1]]
        else:
            self.tops[i] = block[-1]
        self.size += 1

    def around(self, x: int) -> tuple[int, int]:
        """The members before and behind the member ``x``; -1: none."""
        i = bisect_left(self.tops, x)
        block = self.blocks[i]
        k = bisect_left(block, x)
        before = block[k - 1] if k else self.tops[i - 1] if i else -1
        behind = block[k + 1] if k + 1 < len(block) else self.blocks[i + 1][0] if i + 1 < len(self.blocks) else -1
        return before, behind

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


class Automaton:
    """The suffix automaton of a sequence of numbers.  A state's first transition stands in two arrays; a
    dictionary comes with its second one."""

    def __init__(self, symbols: list[int]) -> None:
        self.length, self.link, self.end = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.symbol, self.target, self.more = array("q", [-1]), array("q", [-1]), {}
        last = 0
        for i, c in enumerate(symbols):
            last = self._extend(last, c, i)

    def _new(self, length: int, end: int) -> int:
        self.length.append(length)
        self.link.append(0)
        self.end.append(end)
        self.symbol.append(-1)
        self.target.append(-1)
        return len(self.length) - 1

    def _extend(self, last: int, c: int, i: int) -> int:
        symbol, target, more, link, length = self.symbol, self.target, self.more, self.link, self.length
        cur = self._new(i + 1, i)
        p = last
        while p >= 0:
            if symbol[p] < 0:
                symbol[p], target[p] = c, cur
            elif symbol[p] == c:
                break
            elif p not in more:
                more[p] = {c: cur}
            elif c in more[p]:
                break
            else:
                more[p][c] = cur
            p = link[p]
        if p < 0:
            return cur
        q = target[p] if symbol[p] == c else more[p][c]
        if length[q] == length[p] + 1:
            link[cur] = q
            return cur
        clone = self._new(length[p] + 1, -1)
        symbol[clone], target[clone], link[clone] = symbol[q], target[q], link[q]
        if q in more:
            more[clone] = dict(more[q])
        while p >= 0:
            if symbol[p] == c and target[p] == q:
                target[p] = clone
            elif symbol[p] != c and p in more and more[p].get(c) == q:
                more[p][c] = clone
            else:
                break
            p = link[p]
        link[q] = link[cur] = clone
        return cur


def stretch_runs(symbols: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence of numbers, by start, then period."""
    automaton = Automaton(symbols)
    link, length, end = automaton.link, automaton.length, automaton.end
    floor = LEAST - LEAST // REPEATS
    sets: dict[int, EndPositions] = {}
    fresh: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}
    lengths = np.frombuffer(length, np.int64)
    order = np.argsort(-lengths, kind="stable")
    del automaton

    def seed(x: int, y: int, n: int) -> None:
        d, start = y - x, x - n + 1
        if d * (REPEATS - 1) > n or n + d < LEAST or (start, d) in found or start > 0 and symbols[start - 1] == symbols[start - 1 + d]:
            return
        while y + 1 < len(symbols) and symbols[y + 1] == symbols[y + 1 - d]:
            y += 1
        found[start, d] = y

    for v in order[: int((lengths >= floor).sum())].tolist():
        n, own, new = length[v], end[v], fresh.pop(v, [])
        here = sets.pop(v, None)
        if own >= 0:
            if here is None:
                here = EndPositions(own)
            else:
                here.add(own)
                new.append(own)
        for x in new:
            before, behind = here.around(x)
            if before >= 0:
                seed(before, x, n)
            if behind >= 0:
                seed(x, behind, n)
        p = link[v]
        if length[p] < floor:
            continue
        there = sets.get(p)
        if there is None:
            sets[p], fresh[p] = here, []
            continue
        small, large = (here, there) if here.size <= there.size else (there, here)
        fresh[p] = [*fresh[p], *small] if small is here else list(small)
        for x in small:
            large.add(x)
        sets[p] = large
    return sorted((s, e - s + 1, d) for (s, d), e in found.items())


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one doc_id in ten: of each of ``n`` words, the number of the word that stands there instead."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _stretches(hashes: list[np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """(text number, first word, words) of the stretches whose every window of PROBE words recurs in its text."""
    lens = np.array([len(h) for h in hashes])
    first = np.cumsum(lens) - lens
    prints = window_hashes(np.concatenate(hashes), PROBE)
    text = np.repeat(np.arange(len(lens)), lens)[: len(prints)]
    off = np.flatnonzero(np.arange(len(prints)) + PROBE <= (first + lens)[text])
    key = mix(prints[off] + text[off].astype(U) * _GOLDEN)
    by = np.argsort(key)
    same = key[by][1:] == key[by][:-1]
    again = np.zeros(len(key), bool)
    again[by[1:][same]] = again[by[:-1][same]] = True
    off = off[again]
    if not len(off):
        return
    heads = np.flatnonzero(np.concatenate([[True], (off[1:] != off[:-1] + 1) | (text[off][1:] != text[off][:-1])]))
    size = np.diff(np.append(heads, len(off))) + PROBE - 1
    for k in np.flatnonzero(size >= LEAST).tolist():
        t = int(text[off[heads[k]]])
        yield t, int(off[heads[k]] - first[t]), int(size[k])


def text_runs(texts: list[list[bytes]], hashes: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, given its words and their hashes."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, start, n in _stretches(hashes):
        names: dict[bytes, int] = {}
        symbols = [names.setdefault(w, len(names)) for w in texts[t][start : start + n]]
        out[t] += [(start + s, size, d) for s, size, d in stretch_runs(symbols)]
    return out


def _row(tokens: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    if runs:
        edges = np.zeros(len(tokens) + 1, np.int64)
        for s, n, d in runs:
            edges[s + d] += 1
            edges[s + n] -= 1
        tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    kept = b" ".join(tokens)
    listed = "".join(f"{s},{n},{d}\n" for s, n, d in runs)
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), kept


def find_runs(docs: DataFrame, loops: bool = False, doc_id: Column | str = "doc_id", text: Column | str = "text") -> DataFrame:
    """Per row: doc_id, n_runs, the run of greatest length / period, prints of all runs and of the words that stay, and
    those words.  ``loops``: plant :func:`looped` repeats first."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            rows, texts, hashes, size = [], [], [], 0
            for i in range(batch.num_rows):
                tokens = (column[i].as_py() or b"").split()
                words = cache.of(tokens)
                at = looped(len(tokens), ids[i]) if loops else None
                if at is not None:
                    tokens, words = [tokens[k] for k in at.tolist()], words[at]
                texts.append(tokens)
                hashes.append(words)
                size += len(tokens)
                if size >= CHUNK or i == batch.num_rows - 1:
                    rows += [_row(t, r) for t, r in zip(texts, text_runs(texts, hashes), strict=True)]
                    texts, hashes, size = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names)

    types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.binary()]
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "collapsed"]
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).cast("string").cast("binary").alias("text"))
    out = rows.mapInArrow(find, ", ".join(f"{n} {'string' if n.endswith('sha256') else 'binary' if n == 'collapsed' else 'long'}" for n in names))
    return out.withColumn("collapsed", F.col("collapsed").cast("string"))
