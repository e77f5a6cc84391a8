"""Small documents with the awkward cases, and plain restatements of the contracts."""

import random
import re

EXTRA = ", bands array<int>, row string, `__x` int"


def texts(seed=0, n=40):
    """Random texts with shared lines, shared passages and near copies."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(120)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    line = "A Common Line That Is Long Enough "
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        text = " ".join(w + ("\n" if rng.random() < 0.08 else "") for w in words)
        if i % 5 == 0:
            text = f"{text} {passage}\ntail {i}"
        if i % 4 == 0:
            text = f"{line}\n{text}\n\t{line.upper()}"
        out.append(text)
    for i in range(0, n, 6):  # near copies, and exact ones
        words = out[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        out += [" ".join(words), out[i]]
    return out


def documents(spark, seed=0, n=40, extra=True):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t)) for i, t in enumerate(texts(seed, n))]
    base = len(rows)
    rows += [(base, None, "en", "s1", None), (base + 1, "", None, "s1", 0), (base + 2, " \t\n ", "en", None, 4), (None, "null id " * 30, "en", "s2", 1), (base + 3, "word " * 30_000, "en", "s2", 1)]
    rows += [rows[3], rows[3]]  # repeated rows
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:
        return spark.createDataFrame([(*r, [1], "x", 2) for r in rows], schema + EXTRA)
    return spark.createDataFrame(rows, schema)


def words(text):
    return (text or "").encode().split()


def least(doc_id):
    return -(2**63) if doc_id is None else doc_id


def plain_words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
