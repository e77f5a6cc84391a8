"""HTML pages as sequences of leaf blocks: a text with the elements around it.

Scripts, styles, comments and the head never make blocks. Unclosed elements
end where a browser ends them: a paragraph at the next block, an item at the
next item, anything at the end of an element around it, the head at the first text or element
that is not its own. A dropped element without its end tag ends at the next block tag or the end of an
element around it; only scripts and styles run to the end of the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container
from dataclasses import dataclass

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas title textarea select".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What the head may hold, dropped elements that swallow the page, and those that do not nest.
HEAD = frozenset("base link meta noscript script style template title".split())
SWALLOW = frozenset("script style".split())
FLAT = frozenset("noscript canvas select".split())
LANDMARKS = frozenset("article main nav header footer aside form section table ul ol dl blockquote figure".split())
SIBLINGS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
PEERS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# quotes count behind an equals sign alone; possessive, as a tag is matched once or not at all
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[a-z]+")
_ENDS = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>?", re.I) for name in RAW}
_OPENS = {name: re.compile(rf"<{name}(?![^\s/>])", re.I) for name in FLAT}


class Node:
    """An open element and what a block within it inherits; equal sets are shared with the element around,
    so a page of any depth takes memory in proportion to its length."""

    __slots__ = ("mark", "name", "names", "own", "tags", "turns")

    def __init__(self, name: str, words: frozenset[str], around: Node | None):
        self.name = name
        self.names: frozenset[str] = around.names if around else frozenset()  # words of class, id and role
        self.tags: frozenset[str] = around.tags if around else frozenset()  # block elements and links
        self.turns: frozenset[tuple[str, str]] = around.turns if around else frozenset()  # landmark within landmark
        self.mark: str | None = around.mark if around else None  # nearest landmark
        self.own: str | None = around.own if around else None  # nearest block element
        if not words <= self.names:
            self.names |= words
        if name not in self.tags and (name in BLOCK or name == "a"):
            self.tags |= {name}
        if name in LANDMARKS:
            if self.mark and (self.mark, name) not in self.turns:
                self.turns |= {(self.mark, name)}
            self.mark = name
        if name in BLOCK:
            self.own = name


@dataclass
class Block:
    text: str
    within: Node | None  # the innermost element around it
    linked: int = 0  # characters within links


def _names(attributes: str, known: frozenset[str] | None) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    found = frozenset(w for m in _NAMED.finditer(attributes) for w in _PARTS.findall((m[2] or m[3] or m[4] or "").lower()))
    return found if known is None else found & known


class _Open:
    """The elements open at a place of a page."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.count: Counter[str] = Counter()

    def top(self) -> str | None:
        return self.nodes[-1].name if self.nodes else None

    def push(self, name: str, words: frozenset[str]) -> None:
        self.nodes.append(Node(name, words, self.nodes[-1] if self.nodes else None))
        self.count[name] += 1

    def close(self, names: Container[str], until: Container[str] = ()) -> None:
        """Close the innermost element of ``names`` and all within it, unless one of ``until`` lies between."""
        if not any(self.count[n] for n in names):
            return
        for k in range(len(self.nodes) - 1, -1, -1):
            if self.nodes[k].name in names:
                for node in self.nodes[k:]:
                    self.count[node.name] -= 1
                del self.nodes[k:]
                return
            if self.nodes[k].name in until:
                return


def _raw_end(page: str, at: int, name: str, open_: _Open, ends: dict) -> int:
    """Where a dropped element that was opened before ``at`` ends."""
    end = ends.get(name, False)
    if end is False or end is not None and end.start() < at:
        end = ends[name] = _ENDS[name].search(page, at)
    if name in SWALLOW:
        return end.end() if end else len(page)
    if end and not (name in FLAT and _OPENS[name].search(page, at, end.start())):
        return end.end()
    for m in _TAG.finditer(page, at):
        tag = m[2].lower()
        if tag in BLOCK and tag != "option" or tag == name or m[1] and (open_.count[tag] or tag == "head"):
            return m.start()
    return len(page)


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page, in time and memory in proportion to its length; ``known``: the words of class, id and
    role that are of interest (all, if not given)."""
    out: list[Block] = []
    open_, ends = _Open(), {}
    parts: list[str] = []
    links: list[str] = []
    in_link = False
    at = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, open_.nodes[-1] if open_.nodes else None, len(" ".join(html.unescape("".join(links)).split()))))
            parts, links = [], []

    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m[2]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or len(piece) == 1:
                if open_.top() == "head":
                    if not piece.strip():
                        continue
                    open_.close(("head",))
                parts.append(piece)
                if in_link:
                    links.append(piece)
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK:
                flush()
            open_.close((name,))
            if name == "a":
                in_link = False
            continue
        if open_.top() == "head" and name not in HEAD:
            open_.close(("head",))
        if name in RAW and not m[3].endswith("/"):
            at = _raw_end(page, at, name, open_, ends)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
            in_link = False
            open_.close(("p",), BLOCK)
            if name in SIBLINGS:
                open_.close(PEERS.get(name, (name,)), SIBLINGS[name])
        if name == "a":
            in_link = True
        if name not in VOID and not m[3].endswith("/"):
            open_.push(name, _names(m[3], known))
    flush()
    return out
