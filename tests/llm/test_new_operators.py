"""Tokenizer alignment, toxicity and periodic runs against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import alignment, runs, toxicity
from seqloom.llm.hashing import WordHashes

from .helpers import documents, words

# ---- periodic runs


def literal_runs(s):
    """Every period, every stretch; smaller periods ruled out one by one."""
    n, out = len(s), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(24, 3 * q) and all(any(s[i + k] != s[i + k + p] for k in range(size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out)


def literal_row(text, doc_id, loops):
    s = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if loops and doc_id is not None and h % 10 == 0 and s:
        g, n = h // 10, len(s)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        s = s[:a] + [s[a + (i - a) % p] for i in range(a, n)]
    found = literal_runs(s)
    gone = {i for b, n, q in found for i in range(b + q, b + n)}
    kept = b" ".join(w for i, w in enumerate(s) if i not in gone)
    best = None
    for b, n, q in found:
        if best is None or n * best[2] > best[1] * q:
            best = (b, n, q)
    listed = "".join(f"{b},{n},{q}\n" for b, n, q in found)
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive(rng):
    s = []
    while len(s) < rng.randint(1, 260):
        kind = rng.random()
        if kind < 0.4:
            s += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 20))]
        elif kind < 0.8:
            p = rng.randint(1, rng.choice([2, 5, 20]))
            s += ([rng.choice("abc") for _ in range(p)] * 20)[: rng.randint(p, p * rng.randint(2, 9))]
        else:
            unit = [rng.choice("ab") for _ in range(rng.randint(1, 4))] * rng.randint(1, 4) + [rng.choice("ab")]
            s += unit * rng.randint(2, 8)
    return s


def test_runs_of_a_stretch_are_all_runs():
    rng, cache = random.Random(1), WordHashes()
    for _ in range(400):
        tokens = [w.encode() for w in repetitive(rng)]
        want = literal_runs(tokens)
        names = {}
        assert runs.stretch_runs([names.setdefault(w, len(names)) for w in tokens]) == want
        assert runs.text_runs([tokens, [], tokens], [cache.of(tokens), cache.of([]), cache.of(tokens)]) == [want, [], want]


def test_end_positions_stay_ordered_over_many_blocks():
    rng = random.Random(4)
    values = rng.sample(range(50_000), 6000)
    ends = runs.EndPositions(values[0])
    for x in values[1:]:
        ends.add(x)
    want = sorted(values)
    assert list(ends) == want and len(ends.blocks) > 3
    for x in rng.sample(values, 300):
        k = want.index(x)
        assert ends.around(x) == (want[k - 1] if k else -1, want[k + 1] if k + 1 < len(want) else -1)


@pytest.mark.parametrize("loops", [False, True])
def test_find_runs_matches_the_contract(spark, loops):
    rng = random.Random(7)
    rows = [(i, " ".join(repetitive(rng)) if i % 3 else "a b " * rng.randint(0, 40)) for i in range(120)]
    rows += [(None, "x " * 40), (500, None), (501, ""), (502, " \n "), (0, "x y z " * 12), rows[5], rows[5]]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, start int, `n.runs` double")
    got = sorted(map(str, map(tuple, runs.find_runs(frame, loops=loops).drop("collapsed").collect())))
    assert got == sorted(str(literal_row(t, i, loops)) for i, t in rows)
    assert sum("None, None" not in r for r in got) > 20


def test_find_runs_of_long_texts_and_none(spark):
    frame = spark.createDataFrame([(1, "word " * 200_000), (2, "α β γ\n" * 50_000 + "end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.collapsed) for r in runs.find_runs(frame).collect()}
    assert got == {1: (1, 0, 200_000, 1, "word"), 2: (1, 0, 150_000, 3, "α β γ end")}
    assert runs.find_runs(frame.limit(0)).collect() == []


# ---- alignment of tokenizers

PARTS = ["a", "B", " ", "  ", "\n", " \n", "\t", "the", " of", "▁", "é", "ﬁ", "日本", "😀", "<|endoftext|>", "<s>", "<0x41>", "'s", "12", "...", "\x00", " ", "\x1c", "　", "\r\n", "<unk>"]


@pytest.fixture(scope="module")
def sides():
    tokenizers = pytest.importorskip("tokenizers")
    a = tokenizers.Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.SIDE_A}")
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    of_a = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
    import sentencepiece

    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.SIDE_B}")

    def coded(text):
        """(A ids, B ids, groups), whole text by whole text."""
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [of_a[i] for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return None
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        cuts, groups, i, j = sorted({*ends_a.tolist()} & {*ends_b.tolist()}), [], 0, 0
        for e in cuts:
            k, m = int((ends_a <= e).sum()), int((ends_b <= e).sum())
            groups.append((ids_a[i:k], ids_b[j:m]))
            i, j = k, m
        return ids_a, ids_b, groups

    return coded


def literal_alignment(rows, coded):
    done = [(i, coded(t)) for i, t in rows]
    counts = Counter((b[-1], a[-1]) for _, x in done if x for a, b in x[2])
    best = {}
    for (b, _), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, x in done:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(b[-1], a[-1]) for a, b in x[2]]
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x[2])
        out.append((i, len(x[0]), len(x[1]), len(links), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(map(str, out)), counts, best


def mixed_rows(seed, n):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16)))) for i in range(n)]
    return rows + [(None, "null id text"), (n, None), (n + 1, ""), (n + 2, " "), (n + 3, "x" * 3000 + " end "), rows[3], rows[3], (3, "another text")]


def test_align_matches_whole_texts(spark, sides, monkeypatch):
    rows = mixed_rows(1, 400) + [(1000 + i, t) for i, t in enumerate(x.text for x in documents(spark, n=12, extra=False).collect())]
    # small bounds, so that there are several portions, cells and generations of remembered chunks
    monkeypatch.setattr(alignment, "CHUNKS", 300)
    monkeypatch.setattr(alignment, "CELL", 2)
    monkeypatch.setattr(alignment, "CACHED", 100)
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, stripe int, `a.b` string").repartition(3)
    want, _, _ = literal_alignment(rows, sides)
    got = alignment.align(frame).select("doc_id", *alignment._NUMBERS, "groups_sha256")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert alignment.align(frame.limit(0)).collect() == []


def test_pair_counts(spark, sides):
    rows = mixed_rows(2, 100)
    _, counts, best = literal_alignment(rows, sides)
    got = {(r.id_b, r.id_a): (r["count"], r.best) for r in alignment.pair_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (n, n == best[k[0]]) for k, n in counts.items()}


# ---- toxicity

INSULTS = ["zorgle", "flibber"]


def spoken(rng, toxic, n=None):
    """Common words; toxic texts hold an insult, a phrase, or two words around another."""
    tokens = [rng.choice("the of and in to was on with as that".split()) for _ in range(n or rng.randint(5, 60))]
    at = rng.randrange(len(tokens) - 3)
    if toxic:
        tokens[at : at + 3] = [[rng.choice(INSULTS), "and", "of"], ["drop", "dead", "the"], ["so", rng.choice(["very", "utterly", "plain"]), "low"]][rng.randrange(3)]
    elif rng.random() < 0.6:  # the parts of a phrase alone
        tokens[at] = rng.choice(["drop", "dead", "so", "low"])
    return " ".join(tokens)


def labelled(spark, seed=1, n=1500):
    rng = random.Random(seed)
    rows = [(i, spoken(rng, i % 5 == 0), int(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_features_are_words_neighbours_and_skips():
    got = toxicity.features("One two, ONE two! thré".encode(), WordHashes())
    assert len(got) == 5 + 4 + 3 and len(set(got.tolist())) == 3 + 3 + 3 and got.max() < 1 << toxicity.BITS


def test_train_is_ftrl(spark):
    """Against the update rule written out for one weight after the other."""
    rng = random.Random(2)
    rows = [np.unique(np.array(rng.sample(range(20), 6), np.uint64)) for _ in range(200)]
    y = [int(3 in r or rng.random() < 0.1) for r in rows]
    z, n, w = {}, {}, {}
    for _ in range(3):
        for x, t in zip(rows, y, strict=True):
            x = [*x.tolist(), "bias"]
            p = 1 / (1 + np.exp(-sum(w.get(i, 0.0) for i in x)))
            for i in x:
                g = p - t
                s = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - s * w.get(i, 0.0)
                n[i] = n.get(i, 0.0) + g * g
                l1 = 0.0 if i == "bias" else toxicity.L1
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA)
    got = toxicity.train(rows, y, 3)
    assert abs(got.bias - w.pop("bias")) < 1e-9
    want = {i: v for i, v in w.items() if v}
    assert want and {int(h): round(float(v), 9) for h, v in zip(got.hashes, got.values, strict=True)} == {i: round(float(v), 9) for i, v in want.items()}


def test_toxic_texts_are_caught_and_clean_ones_left(spark):
    rows = labelled(spark)
    rng = random.Random(9)
    fresh = [(10_000 + i, spoken(rng, i % 2 == 0, 3000), None) for i in range(40)]
    docs = rows.union(spark.createDataFrame(fresh, "doc_id long, text string, toxic int")).select("doc_id", "text", "toxic")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, rows.select("doc_id", "toxic")).collect()}
    assert len(got) == 1540
    held = [r for i, r in got.items() if i < 10_000 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items()) and len(held) > 200
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert sum(got[i].predicted == (i % 2 == 0) for i, _, _ in fresh) >= 38
    assert all(r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_held_out_are_not_learned_from(spark):
    rows = labelled(spark, n=600)
    held = toxicity.held_out(rows.doc_id)
    turned = rows.withColumn("toxic", toxicity.F.when(held, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = (toxicity.fit(rows.select("doc_id", "text"), x.select("doc_id", "toxic")) for x in (rows, turned))
    assert a.bias == b.bias and (a.hashes == b.hashes).all() and (a.values == b.values).all() and len(a.hashes)


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1), (4, 0)], "doc_id long, toxic int")
    docs = documents(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    empty = toxicity.toxicity(docs.limit(0), labels)
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "score", "predicted"]
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_the_sample_is_bounded_and_whole(spark, monkeypatch):
    """So many rows and features at most, in the order of a hash, whole rows, and the same ones however the tables are dealt."""
    rows = labelled(spark, n=300)
    train = toxicity.train
    laid = toxicity._laid(rows, rows, 50).orderBy(toxicity.F.xxhash64("doc_id")).collect()
    assert len(laid) == 50 and not any(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in laid)
    size = [r.n for r in laid]
    assert [len(r.features) // 8 for r in laid] == size
    most = sum(size[:20]) + size[20] - 1  # the next row does not fit
    weights = [toxicity.fit(f, f, 50, most) for f in (rows, rows.repartition(7))]
    want = train([np.frombuffer(r.features, np.uint64) for r in laid[:20]], [r.label for r in laid[:20]])
    for w in weights:
        assert w.bias == want.bias and (w.hashes == want.hashes).all() and (w.values == want.values).all()
