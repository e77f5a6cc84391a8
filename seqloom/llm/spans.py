"""Substring dedup over the compacted De Bruijn graph of the corpus's words.

Edges are the token k-mers: ``WINDOW`` consecutive words.  Two edges meet in the node of the
``WINDOW - 1`` words that they share; the distinct edges before an edge, and behind it, are its in- and
out-degree, where the start and the end of a text count as an edge of their own.  Edges that one
document alone holds are dropped before any compaction.  A link from an edge to the next does not branch
if it is the only one out of the first and the only one into the second; then both have the same
occurrences, so a nonbranching path has one set of holders, and its first holder's coordinates (doc_id, row,
first word) name it.

1. Edges travel by minimizer (the ``LABEL``-word label with the least hash among those an edge holds), so that
   neighbouring edges mostly travel together, as runs: one record with source coordinates, a 64-bit
   print of each edge, and 32 bits of the edge before and behind the run.  A task first merges what repeats among its own
   texts, ``DEALT`` words at a time, counted: an occurrence whose words a smaller document of the task has, word by word, stays
   behind as an alias of the first one there, whose edge then says how many it stands for and whether all of them have
   its neighbours.  So degrees and numbers of occurrences are those of the corpus, however the texts are dealt.
2. In a bucket of labels, edges of several documents get their degrees and number of occurrences, and nonbranching
   links inside a run join edges to pieces.
3. Pieces join across buckets on coordinates: the end of one is the start of the next in the first holder's
   text, with the same number of occurrences.  Linked pieces make the paths.
4. Occurrences in larger documents join the paths, and both sides are verified on the words at their source
   coordinates (a 128-bit print of the words there); the edges of a span whose words are not the first holder's are
   judged one by one.
5. Aliases get the paths of the text that they are aliases of, cut to their own extent.  Every removed word lies in an
   occurrence of a path.

Runs travel as column blocks, one record for each (task portion, bucket), in numpy; Spark
partitions and shuffles them.  A passage that a third of all documents hold reaches its bucket as one record a
portion, not one a document.

Edge cases: a null or empty text, and one of fewer than ``WINDOW`` words, loses nothing; a null
doc_id lies below all others; rows that share a doc_id never cost each other
words, and each is returned with its own text; no rows give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, own_id, row_id
from .hashing import U, WordHashes, from_planes, mix, planes, sliding_argmin, window_hashes

WINDOW = 13
#: Words of a label; an edge then holds WINDOW - LABEL + 1 = 8 of them.
LABEL = 6
#: Buckets of labels: this many for each partition of the input, within bounds that keep the blocks of a
#: portion long and a bucket within a task's memory.
BUCKETS, LEAST_BUCKETS, MOST_BUCKETS = 4, 64, 1 << 20
#: Words that a task lays out in arrays at once (a longer text is laid out alone).
CHUNK = 125_000
#: Words whose edges a task merges and deals over the buckets at once.
DEALT = 250_000

_BLOCK = "bucket int, n int, label binary, doc binary, row binary, start binary, count binary, before binary, after binary, print binary, more binary, flags binary"
#: What a bucket returns: aliases, occurrences of pieces in larger documents, pieces.
_ALIAS, _OCCURRENCE, _PIECE = 0, 1, 2
#: What is known of an edge's aliases: that there are some, that one has another edge before it, or behind it.
_HELD, _LEFT, _RIGHT = 1, 2, 4
_FOUND = "kind int, doc_id long, row long, start int, holder long, holder_row long, holder_start int, n int, occurrences long, into boolean, out boolean"
_HOLDER = ["holder", "holder_row", "holder_start"]


def _edges(texts: list[list[bytes]], cache: WordHashes) -> tuple[np.ndarray, ...]:
    """The word hashes of some texts, and of every edge: its label, the label's place, text number, first word,
    print and place of the first word among all words."""
    lens = np.array([len(t) for t in texts])
    words = np.concatenate([cache.of(t) for t in texts])
    labels = window_hashes(words, LABEL)
    at = sliding_argmin(labels, WINDOW - LABEL + 1)
    first = np.cumsum(lens) - lens
    text = np.repeat(np.arange(len(texts)), lens)[: len(at)]
    off = np.flatnonzero(np.arange(len(at)) + WINDOW <= (first + lens)[text])
    at, text = at[off], text[off]
    small = lambda x: x.astype(np.int32)
    return words, mix(labels[at]), small(at), small(text), (off - first[text]).astype(np.uint32), window_hashes(words, WINDOW)[off], small(off)


def _several(label: np.ndarray, doc: np.ndarray, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Records whose label several documents hold, or that are ``held`` by several, by label; the number of their label."""
    order = np.argsort(label, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], label[order][1:] != label[order][:-1]]))
    shared = np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads)
    if held is not None:
        shared |= np.logical_or.reduceat(held[order], heads)
    group = np.repeat(np.arange(len(heads), dtype=np.int32), np.diff(np.append(heads, len(order))))
    keep = shared[group]
    return order[keep], group[keep]


def _merged(words: np.ndarray, label: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, prints: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each edge that a smaller document of these texts holds too, word by word, the first one there; else -1."""
    out = np.full(len(label), -1, np.int64)
    order, group = _several(label, doc)
    if not len(order):
        return out
    keys = (prints[order], group)
    by = np.lexsort((start[order], row[order], *keys) if row.any() else keys)
    order, group = order[by], group[by]
    del by, keys
    key, d = prints[order], doc[order]
    heads = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])]))
    size = np.diff(np.append(heads, len(order)))
    least = np.repeat(np.minimum.reduceat(d, heads), size)
    source = np.repeat(np.minimum.reduceat(np.where(d == least, np.arange(len(d)), len(d)), heads), size)
    hit = np.flatnonzero(d > least)
    own, other = off[order[hit]], off[order[source[hit]]]
    same = np.ones(len(hit), bool)
    for k in range(WINDOW):
        same &= words[own + k] == words[other + k]
    out[order[hit[same]]] = order[source[hit[same]]]
    return out


def _follows(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each edge but the first lies one word behind the edge before it."""
    return (text[1:] == text[:-1]) & (start[1:] == start[:-1] + 1)


def _dealt(parts: list, ids: np.ndarray, rows: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The edges of some texts as runs, one column block for each bucket of labels; the merged ones as aliases, in
    a block with a bucket below 0 drawn for these texts."""
    base = np.cumsum([0, *[len(p[0]) for p in parts]], dtype=np.int32)
    words, label, at, text, start, prints, off = (np.concatenate(x) for x in zip(*[(p[0], p[1], p[2] + b, p[3], p[4], p[5], p[6] + b) for p, b in zip(parts, base, strict=False)], strict=True))
    parts.clear()
    out: dict[str, list] = {k: [] for k in ("bucket", "n", "label", "doc", "row", "start", "count", "before", "after", "print", "more", "flags")}

    def block(bucket: int, text, start, count, label=b"", before=b"", after=b"", prints=b"", more=b"", flags=b"") -> None:
        out["bucket"].append(bucket)
        out["n"].append(len(text))
        out["doc"].append(planes(np.diff(ids[text], prepend=np.int64(0))))
        out["row"].append(planes(rows[text]))
        out["start"].append(planes(start))
        for k, v in (("count", count), ("label", label), ("before", before), ("after", after), ("print", prints), ("more", more), ("flags", flags)):
            out[k].append(bytes(v))

    follows = _follows(text, start)
    low = np.maximum((prints & U(0xFFFFFFFF)).astype(np.uint32), 1)  # 0: no edge there
    before = np.concatenate([[0], np.where(follows, low[:-1], 0)]).astype(np.uint32)
    after = np.concatenate([np.where(follows, low[1:], 0), [0]]).astype(np.uint32)
    source = _merged(words, label, ids[text], rows[text], start, prints, off)
    del words, off, low
    more, flags = np.zeros(len(text), np.uint32), np.zeros(len(text), np.uint8)
    gone = np.flatnonzero(source >= 0)
    if len(gone):
        held = source[gone]
        np.add.at(more, held, 1)
        np.bitwise_or.at(flags, held, (_HELD | _LEFT * (before[gone] != before[held]) | _RIGHT * (after[gone] != after[held])).astype(np.uint8))
        # an alias goes on while both texts do
        on = np.append(follows, False)
        heads = np.flatnonzero(np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | ~on[gone[:-1]] | (held[1:] != held[:-1] + 1) | ~on[held[:-1]]]))
        count = np.diff(np.append(heads, len(gone))).astype(np.uint32)
        by = np.argsort(ids[text[gone[heads]]], kind="stable")
        t, h = gone[heads][by], held[heads][by]
        drawn = -1 - int(mix(prints[:1] + ids[text[:1]].view(U))[0] % U(buckets))
        block(drawn, text[t], start[t], planes(count[by]), planes(ids[text[h]]), planes(start[h]), planes(rows[text[h]]))
        stay = source < 0
        label, at, text, start, prints, before, after, more, flags = (x[stay] for x in (label, at, text, start, prints, before, after, more, flags))
    heads = np.flatnonzero(np.concatenate([[True], ~_follows(text, start) | (at[1:] != at[:-1])]))
    count = np.diff(np.append(heads, len(text)))
    bucket = ((label[heads] & U(0xFFFFFF)) % U(buckets)).astype(np.int32)
    order = np.lexsort((ids[text[heads]], bucket))
    heads, count, bucket = heads[order], count[order], bucket[order]
    bounds = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h, c = heads[a:b], count[a:b]
        each = np.repeat(h - (np.cumsum(c) - c), c) + np.arange(c.sum())
        f = flags[each]
        some = (planes(more[each]), f.tobytes()) if f.any() else (b"", b"")
        block(int(bucket[a]), text[h], start[h], c.astype(np.uint8).tobytes(), (label[h] >> U(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), before[h].tobytes(), after[h + c - 1].tobytes(), prints[each].tobytes(), *some)
    return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["n"], pa.int32()), *[pa.array(out[k], pa.binary()) for k in list(out)[2:]]], list(out))


def _blocks(buckets: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, rows, texts = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
            parts, held, size, dealt = [], [], 0, 0
            for i in range(len(texts)):
                tokens = texts[i].as_py().split()
                if len(tokens) >= WINDOW:
                    held.append((i, tokens))
                    size += len(tokens)
                last = i == len(texts) - 1
                if held and (size >= CHUNK or last):
                    words, label, at, text, *rest = _edges([t for _, t in held], cache)
                    parts.append((words, label, at, np.array([k for k, _ in held], np.int32)[text], *rest))
                    dealt += size
                    held, size = [], 0
                if parts and (dealt >= DEALT or last):
                    yield _dealt(parts, ids, rows, buckets)
                    dealt = 0

    return blocks


def _result(kind: int, doc, row, start, **more: np.ndarray) -> pa.Table:
    zero = np.zeros(len(doc), np.int64)
    whole = {"kind": zero + kind, "doc_id": doc, "row": row, "start": start, "holder": zero, "holder_row": zero, "holder_start": zero, "n": zero, "occurrences": zero, "into": zero, "out": zero} | more
    types = {"kind": pa.int32(), "start": pa.int32(), "holder_start": pa.int32(), "n": pa.int32(), "into": pa.bool_(), "out": pa.bool_()}
    return pa.table({k: pa.array(v.astype(bool) if types.get(k) == pa.bool_() else v).cast(types.get(k, pa.int64())) for k, v in whole.items()})


def _aliases(block: pa.Table) -> pa.Table:
    """The aliases of a block: their own coordinates, and those in the text that they are aliases of."""
    columns: dict[str, list] = {k: [] for k in ("doc", "row", "start", "count", "label", "before", "after")}
    kinds = {"doc": np.int64, "row": np.int64, "start": np.uint32, "count": np.uint32, "label": np.int64, "before": np.uint32, "after": np.int64}
    for r in zip(*(block.column(k).to_pylist() for k in columns), strict=True):
        for k, v in zip(columns, r, strict=True):
            x = from_planes(v, kinds[k])
            columns[k].append(np.cumsum(x) if k == "doc" else x.astype(np.int64))
    doc, row, start, count, holder, holder_start, holder_row = (np.concatenate(columns[k]) for k in columns)
    return _result(_ALIAS, doc, row, start, n=count, holder=holder, holder_row=holder_row, holder_start=holder_start)


def _graph(block: pa.Table) -> pa.Table:
    """Pieces of one bucket and their occurrences (a bucket below 0: aliases)."""
    if block.column("bucket")[0].as_py() < 0:
        return _aliases(block)
    columns: dict[str, list] = {k: [] for k in ("doc", "row", "start", "count", "label", "before", "after", "print", "more", "flags")}
    for r in zip(*(block.column(k).to_pylist() for k in ("n", *columns)), strict=True):
        n, doc, row, start, count, label, before, after, prints, more, flags = r
        columns["doc"].append(np.cumsum(from_planes(doc, np.int64)))
        columns["row"].append(from_planes(row, np.int64))
        columns["start"].append(from_planes(start, np.uint32).astype(np.int64))
        columns["count"].append(np.frombuffer(count, np.uint8).astype(np.int64))
        raw = np.zeros((n, 8), np.uint8)
        raw[:, :5] = np.frombuffer(label, np.uint8).reshape(-1, 5)
        columns["label"].append(raw.view(U).ravel())
        for k, v, kind in (("before", before, np.uint32), ("after", after, np.uint32), ("print", prints, U)):
            columns[k].append(np.frombuffer(v, kind))
        size = len(columns["print"][-1])
        columns["more"].append(from_planes(more, np.uint32) if more else np.zeros(size, np.uint32))
        columns["flags"].append(np.frombuffer(flags, np.uint8) if flags else np.zeros(size, np.uint8))
    doc, row, start, count, label, before, after, prints, more, flags = (np.concatenate(columns.pop(k)) for k in list(columns))
    # labels that one document alone holds end here
    some, _ = _several(label, doc, np.logical_or.reduceat(flags > 0, np.cumsum(count) - count))
    if not len(some):
        return _result(_PIECE, doc[:0], row[:0], start[:0])
    first = (np.cumsum(count) - count)[some]
    by = np.lexsort((start[some], row[some], doc[some]))
    some, first = some[by], first[by]
    c = count[some]
    run = np.repeat(np.arange(len(some)), c)
    inner = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    key, more, flags = (x[first[run] + inner] for x in (prints, more, flags))
    low = np.maximum((key & U(0xFFFFFFFF)).astype(np.uint32), 1)
    left, right = np.roll(low, 1), np.roll(low, -1)
    left[inner == 0], right[inner == c[run] - 1] = before[some], after[some]
    # edges: sorted by coordinates within, so the first of an edge is its first holder
    of = label[some][run]
    by = np.lexsort((key, of))
    heads = np.flatnonzero(np.concatenate([[True], (key[by][1:] != key[by][:-1]) | (of[by][1:] != of[by][:-1])]))
    size = np.diff(np.append(heads, len(by)))
    d = doc[some][run]

    def of_edge(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(by), values.dtype)
        out[by] = np.repeat(values, size)
        return out

    known = np.bitwise_or.reduceat(flags[by], heads)

    def degree_one(neighbour: np.ndarray, other: int) -> np.ndarray:
        x = neighbour[by]
        least = np.minimum.reduceat(x, heads)
        return of_edge((least > 0) & (least == np.maximum.reduceat(x, heads)) & (known & other == 0))

    source = of_edge(by[heads])
    shared = of_edge((d[by[heads]] < d[by[heads + size - 1]]) | (known & _HELD > 0))
    n_all = of_edge(size + np.add.reduceat(more[by].astype(np.int64), heads))
    into, out = degree_one(left, _LEFT), degree_one(right, _RIGHT)
    linked = np.zeros(len(by), bool)
    linked[1:] = (inner[1:] > 0) & shared[1:] & shared[:-1] & out[:-1] & into[1:] & (n_all[1:] == n_all[:-1])
    begin = np.flatnonzero(shared & ~linked)
    if not len(begin):
        return _result(_PIECE, doc[:0], row[:0], start[:0])
    n = np.bincount(np.cumsum(shared & ~linked)[shared] - 1)
    coordinates = lambda w: (doc[some][run[w]], row[some][run[w]], start[some][run[w]] + inner[w])
    own, held = coordinates(begin), coordinates(source[begin])
    later, lead = own[0] > held[0], source[begin] == begin
    tail = begin + n - 1
    # inside a run a link that branches has been tested
    across = (tail + 1 == len(by)) | np.append(inner[1:] == 0, True)[tail]
    pieces = _result(_PIECE, *(x[lead] * 0 for x in own), holder=held[0][lead], holder_row=held[1][lead], holder_start=held[2][lead], n=n[lead], occurrences=n_all[begin][lead], into=(into[begin] & (inner[begin] == 0))[lead], out=(out[tail] & across)[lead])
    return pa.concat_tables([_result(_OCCURRENCE, *(x[later] for x in own), holder=held[0][later], holder_row=held[1][later], holder_start=held[2][later]), pieces])


def _paths(pieces: DataFrame) -> DataFrame:
    """The holder's coordinates and the number of edges of every maximal nonbranching path: the start of a piece
    joins the end of another, on coordinates."""
    ends = pieces.filter("out").select("holder", "holder_row", (F.col("holder_start") + F.col("n")).alias("holder_start"), "occurrences", F.lit(True).alias("linked"))
    joined = pieces.join(ends, [*_HOLDER, "occurrences"], "left").withColumn("head", ~(F.col("into") & F.coalesce("linked", F.lit(False))))
    # the pieces of a path follow each other in the text of its first holder
    number = F.sum(F.col("head").cast("int")).over(Window.partitionBy("holder", "holder_row").orderBy("holder_start"))
    return joined.withColumn("number", number).groupBy("holder", "holder_row", "number").agg(F.min("holder_start").alias("holder_start"), F.sum("n").cast("int").alias("n")).drop("number")


def _print(tokens: list[bytes], start: int, n: int) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(b" ".join(tokens[start : start + n + WINDOW - 1]))
    return int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True)


def _unlike(placed: DataFrame) -> DataFrame:
    """doc_id, row and first words of the spans whose words are not those at their first holder's coordinates."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds, spans = np.asarray(batch.column(3).offsets), batch.column(3).flatten()
            start, n = np.asarray(spans.field("start")).tolist(), np.asarray(spans.field("n")).tolist()
            held = ~np.asarray(spans.field("sure"))
            bounds = bounds - bounds[0]
            p = np.zeros((len(start), 2), np.int64)
            for i, text in enumerate(batch.column(2)):
                at = (bounds[i] + np.flatnonzero(held[bounds[i] : bounds[i + 1]])).tolist()
                if at:
                    tokens = text.as_py().split()
                    for k in at:
                        p[k] = _print(tokens, start[k], n[k])
            of, keep = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), pa.array(held)
            columns = [*(spans.field(c) for c in _HOLDER), batch.column(0).take(pa.array(of)), batch.column(1).take(pa.array(of)), spans.field("start"), pa.array(p[:, 0]), pa.array(p[:, 1])]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names)

    names = [*_HOLDER, "doc_id", "row", "start", "p1", "p2"]
    prints = cut(placed.filter("spans is not null").select("doc_id", "row", "text", "spans").mapInArrow(look, "holder long, holder_row long, holder_start int, doc_id long, row long, start int, p1 long, p2 long"))
    source = (F.col("doc_id") == F.col("holder")) & (F.col("row") == F.col("holder_row")) & (F.col("start") == F.col("holder_start"))
    held = prints.filter(source).select(*_HOLDER, F.col("p1").alias("q1"), F.col("p2").alias("q2"))
    return prints.filter(~source).join(held, _HOLDER).filter("p1 <> q1 or p2 <> q2").select("doc_id", "row", F.col("start").alias("unlike")).distinct()


def _expanded(group: pa.Table) -> pa.Table:
    """The aliases of one text with the paths that lie in it."""
    column = lambda c: np.asarray(pc.fill_null(group.column(c), 0))
    alias = np.asarray(group.column("alias"))
    at, n, start = column("at"), column("n"), column("start")
    doc, row, holder, holder_row, holder_start = (column(c) for c in ("doc_id", "row", "path", "path_row", "path_start"))
    some, paths = np.flatnonzero(alias), np.flatnonzero(~alias)
    if len(some):
        paths = paths[np.unique(at[paths], return_index=True)[1]]
        first, last = at[paths], at[paths] + n[paths]
        i, j = np.searchsorted(last, at[some], side="right"), np.searchsorted(first, at[some] + n[some], side="left")
        each = np.repeat(np.arange(len(some)), j - i)
        path = np.arange(len(each)) - np.repeat(np.cumsum(j - i) - (j - i), j - i) + np.repeat(i, j - i)
        a = some[each]
        lo, hi = np.maximum(at[a], first[path]), np.minimum(at[a] + n[a], last[path])
        if (hi - lo).sum() != n[some].sum():
            raise RuntimeError("a repeated edge lies in no path")
        p = paths[path]
    else:
        a = p = lo = hi = np.empty(0, np.int64)
    shift = lo - at[p]
    values = [doc[a], row[a], (start[a] + lo - at[a]).astype(np.int32), (hi - lo).astype(np.int32), holder[p], holder_row[p], (holder_start[p] + shift).astype(np.int32)]
    return pa.table([pa.array(v) for v in values], ["doc_id", "row", "start", "n", *_HOLDER])


def _compacted(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, row, text): the paths of the corpus, their occurrences that a bucket has seen, and the aliases."""
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, BUCKETS * rows.rdd.getNumPartitions()))
    found = cut(rows.mapInArrow(_blocks(buckets), _BLOCK).groupBy("bucket").applyInArrow(_graph, _FOUND))
    paths = _paths(found.filter(F.col("kind") == _PIECE))
    occurrences = found.filter(F.col("kind") == _OCCURRENCE).select("doc_id", "row", "start", *_HOLDER).join(paths, _HOLDER).select("doc_id", "row", "start", "n", *_HOLDER)
    return paths, occurrences, found.filter(F.col("kind") == _ALIAS).select("doc_id", "row", "start", "n", *_HOLDER)


def _placed(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with their spans (doc_id, row, start, n, holder, sure)."""
    per = spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n", *_HOLDER, "sure")).alias("spans"))
    return cut(rows.join(per, ["doc_id", "row"], "left").select("doc_id", "row", "text", "spans"))


def _with_sources(spans: DataFrame) -> DataFrame:
    """Spans and, once, the places of their first holders, all to be verified."""
    sources = spans.select(F.col("holder").alias("doc_id"), F.col("holder_row").alias("row"), F.col("holder_start").alias("start"), "n", *_HOLDER).distinct()
    return spans.unionByName(sources).withColumn("sure", F.lit(False))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, row, text) with the spans (start, n, holder) of the paths that lie in them and start in a smaller
    doc_id too, verified, and of those that are first holders themselves (holder = the row itself)."""
    paths, occurrences, aliases = _compacted(rows)
    paths, spans = cut(paths), cut(occurrences)
    # what lies in a text that has aliases: paths that it holds first, and its occurrences of others
    mine = paths.select("holder", "holder_row", F.col("holder_start").alias("at"), "n", F.col("holder").alias("path"), F.col("holder_row").alias("path_row"), F.col("holder_start").alias("path_start"))
    theirs = spans.select(F.col("doc_id").alias("holder"), F.col("row").alias("holder_row"), F.col("start").alias("at"), "n", F.col("holder").alias("path"), F.col("holder_row").alias("path_row"), F.col("holder_start").alias("path_start"))
    lying = mine.unionByName(theirs).join(aliases.select("holder", "holder_row").distinct(), ["holder", "holder_row"], "left_semi").withColumn("alias", F.lit(False))
    both = aliases.withColumnRenamed("holder_start", "at").withColumn("alias", F.lit(True)).unionByName(lying, allowMissingColumns=True)
    sure = both.groupBy("holder", "holder_row").applyInArrow(_expanded, "doc_id long, row long, start int, n int, holder long, holder_row long, holder_start int").withColumn("sure", F.lit(True))
    placed = _placed(rows, _with_sources(spans).unionByName(sure))
    unlike = cut(_unlike(placed).groupBy("doc_id", "row").agg(F.collect_set("unlike").alias("unlike")))
    if unlike.isEmpty():
        return placed
    # edges of a path whose prints are equal and words are not: those of such a span are judged one by one
    listed = placed.join(unlike, ["doc_id", "row"])
    wrong = lambda s: ~s["sure"] & F.array_contains("unlike", s["start"])
    single = listed.select("doc_id", "row", F.explode(F.filter("spans", wrong)).alias("s")).select("doc_id", "row", "s.*", F.explode(F.sequence(F.lit(0), F.col("s.n") - 1)).alias("i"))
    edges = cut(single.select("doc_id", "row", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("n"), "holder", "holder_row", (F.col("holder_start") + F.col("i")).alias("holder_start")))
    still = _unlike(_placed(rows, _with_sources(edges))).withColumnRenamed("unlike", "start")
    right = edges.join(still, ["doc_id", "row", "start"], "left_anti").withColumn("sure", F.lit(True))
    kept = listed.select("doc_id", "row", F.explode(F.filter("spans", lambda s: ~wrong(s))).alias("s")).select("doc_id", "row", "s.*")
    touched = _placed(rows.join(unlike, ["doc_id", "row"], "left_semi"), kept.unionByName(right))
    return placed.join(unlike, ["doc_id", "row"], "left_anti").unionByName(touched)


def dedup_spans(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(row_id().alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))
    # where every doc_id has one text, as it should, the row's print need not travel
    several = rows.groupBy("doc_id").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a < b")
    if several.isEmpty():
        rows = rows.withColumn("row", F.lit(0).cast("long"))
    again = F.filter("spans", lambda s: s["holder"] < F.col("doc_id"))
    joined = repeated_spans(rows).select("doc_id", "text", F.transform(again, lambda s: s["start"]).alias("starts"), F.transform(again, lambda s: s["n"]).alias("counts"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, shas, texts = [], [], [], []
            for text, starts, counts in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                tokens, starts = text.as_py().split(), starts.as_py()
                n_words.append(len(tokens))
                if starts:
                    begin = np.array(starts)
                    edges = np.zeros(len(tokens) + 1, np.int64)
                    np.add.at(edges, begin, 1)
                    np.add.at(edges, begin + np.array(counts.as_py()) + WINDOW - 1, -1)
                    tokens = [tokens[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                kept = b" ".join(tokens)
                n_removed.append(n_words[-1] - len(tokens))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            out = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.binary())] * with_text, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * with_text]
    out = joined.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text binary" * with_text)
    return out.select(own_id(), "n_words", "n_removed", "kept_sha256", *[F.col("text").cast("string").alias("text")] * with_text)
