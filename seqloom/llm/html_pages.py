"""Labelled pages to train the extractor on, made from a seed: each is html with the labels of its blocks.

Layouts vary in landmarks (semantic elements, or only class names, or neither), in
what surrounds the article and in how tidy the markup is.
"""

from __future__ import annotations

import random

# Class names in common use.
NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs mainmenu pagination toc tabs".split(),
    "header": "header masthead banner topbar logo tagline site-header branding".split(),
    "footer": "footer site-footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside widget related recommended rail side trending popular".split(),
    "ad": "ad ads advert advertisement sponsored promo banner-ad adsense sponsor".split(),
    "notice": "cookie notice alert consent gdpr message popup newsletter-notice modal disclaimer".split(),
    "form": "form search login subscribe newsletter signup contact".split(),
    "comments": "comments comment comment-list replies discussion disqus responses reply".split(),
    "share": "share social sharing follow tags meta byline-links".split(),
    "main": "content article post entry story main text body article-body post-content entry-content".split(),
}


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.vocabulary = ["".join(rng.choice("th er on an re he in ed nd ha at en es or".split()) for _ in range(rng.randint(1, 4))) for _ in range(200)]

    def words(self, low: int, high: int) -> str:
        return " ".join(self.rng.choice(self.vocabulary) for _ in range(self.rng.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(f"{self.words(3, 18).capitalize()}{self.rng.choice('.....!?')}" for _ in range(n))

    def raw(self, text: str) -> None:
        self.html.append(text)

    def block(self, tag: str, text: str, label: bool, attrs: str = "", close: bool = True) -> None:
        self.html.append(f"<{tag}{attrs}>{text}" + f"</{tag}>" * close)
        self.labels.append(label)

    def links(self, n: int, listed: bool) -> None:
        """A menu: links in a list, or in one block."""
        if listed:
            self.raw("<ul>")
            for _ in range(n):
                self.block("li", f'<a href="/x">{self.words(1, 3)}</a>', False)
            self.raw("</ul>")
        else:
            self.block("div", " | ".join(f'<a href="/x">{self.words(1, 2)}</a>' for _ in range(n)), False)


def _around(w: _Writer, kind: str, semantic: bool) -> None:
    """Something that is not the article."""
    rng = w.rng
    tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div") if semantic else "div"
    if kind == "comments" and rng.random() < 0.5:
        tag = "section"
    named = kind in ("ad", "notice", "comments", "share") or not semantic or rng.random() < 0.4
    attr = f' {rng.choice(["class", "class", "id"])}="{rng.choice(NAMES[kind])}"' if named else ""
    if kind in ("ad", "notice") and rng.random() < 0.5:
        w.block(tag, w.sentences(rng.randint(1, 3)), False, attr)
        return
    if kind == "footer" and rng.random() < 0.6:
        w.block(tag, rng.choice(["&copy; ", "Copyright ", ""]) + w.words(1, 3) + rng.choice([" &middot; ", " | ", ". "]) + w.sentences(1), False, attr)
        return
    w.raw(f"<{tag}{attr}>")
    if kind in ("nav", "share"):
        w.links(rng.randint(2, 8), rng.random() < 0.8)
    elif kind == "header":
        w.block(rng.choice(["h1", "div", "p", "span"]) if rng.random() < 0.5 else "div", w.words(1, 5), False)
        if rng.random() < 0.5:
            w.links(rng.randint(2, 6), True)
    elif kind == "footer":
        for _ in range(rng.randint(1, 3)):
            w.block("p", w.sentences(1), False)
        w.links(rng.randint(2, 5), rng.random() < 0.6)
    elif kind == "aside":
        w.block(rng.choice(["h2", "h3", "div"]), w.words(1, 4), False)
        if rng.random() < 0.6:
            w.links(rng.randint(2, 6), True)
        for _ in range(rng.randint(0, 2)):
            w.block("p", w.sentences(rng.randint(1, 3)), False)
    elif kind == "form":
        w.block("label", w.words(1, 3), False)
        w.raw('<input name="q">')
        w.block("button", w.words(1, 2), False)
    else:
        for _ in range(rng.randint(1, 4)):
            if kind == "comments" and rng.random() < 0.5:
                w.block(rng.choice(["h3", "span", "div"]) if rng.random() < 0.9 else "h4", w.words(1, 4), False) if rng.random() < 0.5 else w.block("div", w.words(1, 3), False)
            w.block(rng.choice(["p", "div"]), w.sentences(rng.randint(1, 4)), False)
    w.raw(f"</{tag}>")


def _article(w: _Writer, semantic: bool, inner: bool) -> None:
    rng = w.rng
    tag = rng.choice(["article", "article", "main"]) if semantic else "div"
    attr = f' {rng.choice(["class", "id"])}="{rng.choice(NAMES["main"])}"' if not semantic and rng.random() < 0.8 or rng.random() < 0.3 else ""
    w.raw(f"<{tag}{attr}>")
    headed = rng.random() < 0.15
    w.raw("<header>" * headed)
    if rng.random() < 0.9:
        w.block("h1", w.words(2, 12).capitalize() + rng.choice(["", "."]), True)
    w.raw("</header>" * headed)
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if kind < 0.7:
            text = w.sentences(rng.randint(1, 8)) if rng.random() < 0.85 else w.words(1, 5).capitalize() + "."
            if rng.random() < 0.15:
                text = f'{text} <a href="/y">{w.words(1, 3)}</a> {w.sentences(1)}'
            loose = rng.random() < 0.2
            w.block("p", ("<b>" if loose else "") + text + ("<br>" if loose else ""), True, close=not loose)
        elif kind < 0.8:
            w.block(rng.choice(["h2", "h3"]), w.words(1, 7).capitalize(), True)
        elif kind < 0.88:
            w.raw("<ul>")
            for _ in range(rng.randint(2, 4)):
                w.block("li", w.words(2, 12), True)
            w.raw("</ul>")
        elif kind < 0.93:
            w.block("blockquote", w.sentences(2), True)
        elif kind < 0.97:
            w.block("pre", w.words(4, 20), True)
        else:
            w.raw("<table><tr>")
            for _ in range(3):
                w.block("td", w.words(1, 4), True)
            w.raw("</tr></table>")
        if inner and rng.random() < 0.15:
            _around(w, rng.choice(["ad", "share", "aside", "notice", "form"]), semantic)
    w.raw(f"</{tag}>")


def page(rng: random.Random) -> tuple[str, list[bool]]:
    w = _Writer(rng)
    semantic, bare = rng.random() < 0.65, rng.random() < 0.06
    w.raw(f"<!DOCTYPE html><html><head><title>{w.words(2, 6)}</title><style>p{{margin:0}}</style><script>track();</script></head><body>")
    if bare:  # nothing but text
        for _ in range(rng.randint(1, 4)):
            w.block(rng.choice(["p", "p", "div"]), w.sentences(rng.randint(1, 5)), True)
        return "".join(w.html), w.labels
    for kind, odds in (("notice", 0.25), ("header", 0.5), ("nav", 0.85), ("form", 0.2), ("ad", 0.5), ("aside", 0.15)):
        if rng.random() < odds:
            _around(w, kind, semantic)
    _article(w, semantic, rng.random() < 0.4)
    for kind, odds in (("share", 0.25), ("ad", 0.2), ("comments", 0.35), ("aside", 0.35), ("form", 0.2), ("nav", 0.1), ("footer", 0.85), ("notice", 0.12)):
        if rng.random() < odds:
            _around(w, kind, semantic)
    w.raw("</body></html>" * (rng.random() < 0.9))
    return "".join(w.html), w.labels


def labelled_pages(n: int, seed: int = 7) -> list[tuple[str, list[bool]]]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
