"""HTML extraction: a linear-chain conditional random field over leaf blocks.

Blocks are labelled article or not from binary features of the elements around
them and of their text, and from the label before; the weights maximise the
conditional likelihood of labelled pages, and pages are decoded by Viterbi.
Training sees ``TRAINING_PAGES`` pages, whatever the input; the weights go to the tasks
with the function.  Pages are independent: no shuffle.

Parsing takes time and memory in proportion to the page's length, however it is nested or broken.

Edge cases: a null or empty page, or one without text, gives the empty text; pages repeat as given;
a page with one block is decided by that block; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_blocks import Block, Node, blocks
from .html_pages import labelled_pages

TRAINING_PAGES = 400
STEPS, RATE, L2 = 120, 0.15, 1e-3


def _inherited(within: Node | None) -> list[str]:
    if within is None:
        return ["own -", "near -"]
    return [f"own {within.own or '-'}", f"near {within.mark or '-'}", *(f"in {t}" for t in within.tags), *(f"two {a} {b}" for a, b in within.turns), *(f"named {w}" for w in within.names)]


def features(page: Sequence[Block]) -> list[list[str]]:
    out = []
    n = len(page)
    longest = max((len(b.text) for b in page), default=1)
    for i, b in enumerate(page):
        size = len(b.text.split())
        share = b.linked / max(1, len(b.text))
        found = ["bias", f"words {min(8, size.bit_length())}", f"links {0 if not share else 1 if share < 0.4 else 2 if share < 0.8 else 3}", f"ends {'stop' if b.text[-1] in '.!?:”»' else 'open'}", f"place {'first' if i == 0 else 'last' if i == n - 1 else 'inside'}", f"against longest {min(4, int(5 * len(b.text) / longest))}", *_inherited(b.within)]
        if "©" in b.text or "copyright" in b.text.lower():
            found.append("copyright")
        out.append(sorted(found))
    return out


class Tagger:
    """Weights of the field: per feature and label, and per pair of neighbouring labels."""

    def __init__(self, weights: dict[str, tuple[float, float]], steps: np.ndarray, first: np.ndarray):
        self.weights, self.steps, self.first = weights, steps.tolist(), first.tolist()
        self.known = frozenset(n.removeprefix("named ") for n in weights if n.startswith("named "))

    def decode(self, page: Sequence[Block]) -> list[bool]:
        """Viterbi."""
        if not page:
            return []
        scores = []
        for names in features(page):
            a = b = 0.0
            for name in names:
                w = self.weights.get(name)
                if w:
                    a += w[0]
                    b += w[1]
            scores.append((a, b))
        (s00, s01), (s10, s11) = self.steps
        x, y = self.first[0] + scores[0][0], self.first[1] + scores[0][1]
        back = []
        for a, b in scores[1:]:
            from0, from1 = x + s00 >= y + s10, x + s01 >= y + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            x, y = (x + s00 if from0 else y + s10) + a, (x + s01 if from1 else y + s11) + b
        labels = [int(y > x)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return [bool(v) for v in reversed(labels)]

    def text(self, page: str | None) -> str:
        found = blocks(page, self.known) if page else []
        return " ".join(b.text for b, keep in zip(found, self.decode(found), strict=True) if keep)


def train(pages: Sequence[tuple[str, Sequence[bool]]], steps: int = STEPS) -> Tagger:
    """Maximise the conditional log likelihood (forward-backward over all pages at once, Adam)."""
    parsed = [(features(blocks(h)), list(labels)) for h, labels in pages]
    parsed = [(f, y) for f, y in parsed if f and len(f) == len(y)]
    names = {name: k for k, name in enumerate(sorted({n for f, _ in parsed for block in f for n in block}))}
    n, longest = len(parsed), max(len(f) for f, _ in parsed)
    x = np.zeros((n * longest, len(names)), np.float32)
    y = np.zeros((n, longest), np.int64)
    live = np.zeros((n, longest), bool)
    for i, (f, labels) in enumerate(parsed):
        for t, block in enumerate(f):
            x[i * longest + t, [names[k] for k in block]] = 1
        y[i, : len(f)], live[i, : len(f)] = labels, True
    w, a, p = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    lens = live.sum(axis=1)
    gold = np.eye(2)[y] * live[:, :, None]
    gold_pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    state = [(np.zeros_like(v), np.zeros_like(v)) for v in (w, a, p)]
    add = lambda v, axis: np.logaddexp.reduce(v, axis=axis)
    for step in range(1, steps + 1):
        s = (x @ w.astype(np.float32)).reshape(n, longest, 2).astype(float)
        f = np.zeros((n, longest, 2))
        b = np.zeros((n, longest, 2))
        f[:, 0] = s[:, 0] + p
        for t in range(1, longest):
            f[:, t] = np.where(live[:, t, None], s[:, t] + add(f[:, t - 1, :, None] + a, 1), f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], add(a + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = add(f[np.arange(n), lens - 1], 1)
        node = np.exp(f + b - z[:, None, None]) * live[:, :, None]
        pair = np.exp(f[:, :-1, :, None] + a + (s + b)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        grads = ((x.T @ (gold - node).reshape(-1, 2).astype(np.float32)) / n - L2 * w, (gold_pairs - pair.sum(axis=(0, 1))) / n, (gold[:, 0] - node[:, 0]).sum(axis=0) / n)
        for v, g, (m1, m2) in zip((w, a, p), grads, state, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            v += RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return Tagger({k: (float(w[i, 0]), float(w[i, 1])) for k, i in names.items()}, a, p)


@functools.lru_cache
def default_tagger() -> Tagger:
    return train(labelled_pages(TRAINING_PAGES))


def extract(pages: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    tagger = tagger or default_tagger()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [tagger.text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    columns = pages.select("page_id", "url", "html")
    schema = f"page_id {columns.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return columns.mapInArrow(run, schema)
