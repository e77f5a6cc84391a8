"""Quality rules: learned decision lists (DataFrame functions only).

Base measures are column expressions over the words and lines of a text.  For
learning, every labelled row is binned per feature at quantile edges; Spark
counts labels per cell of bins, and the driver gets those counts - at most
``2 * (BINS + 1) ** len(FEATURES)`` cells, whatever the corpus size.  Sequential
covering then grows conjunctions of thresholds on one half of the cells' rows by
FOIL gain, prunes each on the other half, and stops at a conjunction that is not
right often enough.  The ordered list becomes one Spark ``when`` chain.

Edge cases: a null text has no words and fails the base rule, as any text under
20 words does; labels of unknown documents, null labels and repeated labels
count as given; without labels, or with one class alone, the list is empty and
every text that passes the base rule is kept; repeated rows are judged alike; no
rows give no rows; other columns are carried along by :func:`judged`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words

WINDOW = 8
FEATURES = ("symbols", "upper", "marks", "dup_lines", "repeats", "word_len")
#: Quantile edges a feature.
BINS = 7
#: A rule is kept if this share of what it covers among held-out rows is bad, and it covers so many.
MIN_PRECISION, MIN_COVER = 0.8, 5
MAX_RULES, MAX_TERMS = 12, 3


def _repeated(ws: Column) -> Column:
    """Words in 8-word windows found twice or more in the text."""
    n = F.size(ws)

    def positions(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(o: Column) -> Column:
            again = F.filter(o, lambda x, k: F.when(k > 0, F.get(o, k - 1)["h"] == x["h"]).otherwise(F.lit(False)) | F.coalesce(F.get(o, k + 1)["h"] == x["h"], F.lit(False)))
            starts = F.sort_array(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
            step = lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end"))
            return F.aggregate(starts, start, step, lambda a: a["n"])

        # most texts repeat no window, and need no sort
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, covered))

    def windows(wh: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(wh, i + k) for k in range(WINDOW)]))

    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), positions))


def base_measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as columns over ``ws`` and the text."""
    ws, text = F.col("__seqloom_ws"), F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, r"(?s)^[\x20\x09-\x0D]+", "")) > 0)
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.array_join(ws, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeated(ws).cast("long"),
        "n_upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long"),
        "n_marks": F.length(F.regexp_replace(text, r"[^!?]+", "")).cast("long"),
    }


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the base measures, base_failed and the learner's features in a struct ``__seqloom_quality``."""
    out = docs.withColumn("__seqloom_ws", words(F.col("text")))
    measures = base_measures(F.col("text"))
    out = out.withColumn("__seqloom_m", F.struct(*[c.alias(k) for k, c in measures.items()]))
    m = F.col("__seqloom_m")
    failed = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
    per = lambda top, of: F.round(m[top] / F.greatest(m[of], F.lit(1)), 4)
    features = {"symbols": per("n_symbols", "n_words"), "upper": per("n_upper", "word_chars"), "marks": per("n_marks", "n_words"), "dup_lines": per("n_dup_lines", "n_words"), "repeats": per("n_repeat_words", "n_words"), "word_len": per("word_chars", "n_words")}
    fields = [m[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return out.withColumn("__seqloom_quality", F.struct(*fields, failed.alias("base_failed"), *[features[k].alias(k) for k in FEATURES])).drop("__seqloom_ws", "__seqloom_m")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, 'above' | 'at most', threshold) that marks a text as bad."""

    terms: tuple[tuple[str, str, float], ...]

    def column(self, feature) -> Column:
        tests = [feature(f) > t if way == "above" else feature(f) <= t for f, way, t in self.terms]
        out = tests[0]
        for test in tests[1:]:
            out = out & test
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>' if way == 'above' else '<='} {t:g}" for f, way, t in self.terms)


def verdict(rules: Sequence[Rule], feature) -> Column:
    """The ordered list as a conditional expression: true keeps the text."""
    out = F
    for rule in rules:
        out = out.when(rule.column(feature), F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def learn(labelled: DataFrame) -> list[Rule]:
    """``labelled`` has the features and ``quality`` (0 bad, 1 good)."""
    rows = labelled.filter("quality in (0, 1)").filter(~F.col("base_failed"))
    marks = [(i + 1) / (BINS + 1) for i in range(BINS)]
    # edges from the bad rows and from all rows: where either class is dense
    half = [round(m, 4) for m in marks[:: 2]], [round(m, 4) for m in marks[1:: 2]]
    edges = rows.agg(*[F.array_union(F.coalesce(F.percentile_approx(f, half[0], 1000), F.array().cast("array<double>")), F.coalesce(F.percentile_approx(F.when(F.col("quality") == 0, F.col(f)), half[1], 1000), F.array().cast("array<double>"))).alias(f) for f in FEATURES]).first()
    edges = {f: sorted(set(edges[f] or [])) for f in FEATURES}
    bin_of = lambda f: sum(((F.col(f) > e).cast("int") for e in edges[f]), F.lit(0)).alias(f)
    binned = [bin_of(f) for f in FEATURES]
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("held")
    cells = rows.select("quality", part, *binned).groupBy(*FEATURES, "held").agg(F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad"), F.sum("quality").alias("good")).collect()
    return cover([(tuple(c[f] for f in FEATURES), c["held"], c["bad"], c["good"]) for c in cells], edges)


def cover(cells: list[tuple[tuple[int, ...], bool, int, int]], edges: dict[str, list[float]]) -> list[Rule]:
    """Sequential covering over counted cells (bins, held out, bad, good), all tests of a step at once."""
    tests = [(j, way, k) for j, f in enumerate(FEATURES) for k in range(len(edges[f])) for way in ("above", "at most")]
    if not cells or not tests:
        return []
    cells = sorted(cells)
    bins = np.array([c[0] for c in cells])
    held, bad, good = (np.array([c[k] for c in cells], kind) for k, kind in ((1, bool), (2, float), (3, float)))
    fits = np.array([bins[:, j] > k if way == "above" else bins[:, j] <= k for j, way, k in tests])
    left, rules = np.ones(len(cells), bool), []

    def inside(terms: list[int]) -> np.ndarray:
        return left & fits[terms].all(axis=0)

    def counts(terms: list[int]) -> tuple[float, float]:
        rows = inside(terms) & held
        return bad[rows].sum(), good[rows].sum()

    def precision(terms: list[int]) -> float:
        b, g = counts(terms)
        return (b - g) / (b + g) if b + g else -1.0

    while len(rules) < MAX_RULES:
        terms: list[int] = []
        while len(terms) < MAX_TERMS:
            rows = inside(terms) & ~held
            n_bad, n_good = bad[rows].sum(), good[rows].sum()
            if not n_bad or not n_good:
                break
            b, g = fits[:, rows] @ bad[rows], fits[:, rows] @ good[rows]
            gain = np.where(b > 0, b * (np.log2(np.maximum(b, 1) / np.maximum(b + g, 1)) - math.log2(n_bad / (n_bad + n_good))), 0.0)
            if gain.max() <= 1e-9:
                break
            terms.append(int(np.argmax(gain)))
        while len(terms) > 1:
            shorter = max((terms[:i] + terms[i + 1 :] for i in range(len(terms))), key=precision)
            if precision(shorter) < precision(terms):
                break
            terms = shorter
        b, g = counts(terms)
        if not terms or b + g < MIN_COVER or b < MIN_PRECISION * (b + g):
            break
        rules.append(Rule(tuple((FEATURES[tests[t][0]], tests[t][1], edges[FEATURES[tests[t][0]]][tests[t][2]]) for t in terms)))
        left &= ~fits[terms].all(axis=0)
    return rules


def measures_table(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of every text, written to scratch."""
    return cut(measured(docs.select("doc_id", "text")).select("doc_id", "__seqloom_quality.*"))


def learn_from(measures: DataFrame, labels: DataFrame) -> list[Rule]:
    known = labels.select(F.col("doc_id").alias("_labelled"), "quality")
    return learn(measures.join(known, F.col("doc_id") == F.col("_labelled")))


def fit(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """Learn from every labelled document of ``docs``; the others are not measured."""
    known = labels.select(F.col("doc_id").alias("_labelled"))
    return learn_from(measures_table(docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("_labelled"), "left_semi")), labels)


def judged(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``docs`` with ``__seqloom_quality`` and ``__seqloom_kept``."""
    out = measured(docs)
    return out.withColumn("__seqloom_kept", F.when(F.col("__seqloom_quality.base_failed"), F.lit(False)).otherwise(verdict(rules, lambda f: F.col(f"__seqloom_quality.{f}"))))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn, then doc_id, the base measures, base_failed, kept.

    Measures are computed once, over all texts, and written to scratch; learning joins them
    with the labels."""
    rows = measures_table(docs)
    rules = learn_from(rows, labels)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules, F.col))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
