"""Leaf blocks of an HTML page: their text, the path of elements above them and their links."""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

# Tags without < or > in a quoted value are matched whole; of the others only the name, and _Tags finds the end.
_START = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>"']*)(?:((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>)?""", re.S
)
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(?=[\s/>]|\Z))""", re.I)
_PIECE = re.compile(r"[A-Za-z]+")
# Elements whose content is not text of the page.
SILENT = {"script", "style", "noscript", "template", "svg", "iframe", "object", "title", "textarea", "select", "canvas", "audio", "video"}
# Those whose content holds no tags: without an end tag they go on to the end of the page, as in a browser.
RAW = {"script", "style", "title", "textarea", "iframe"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr",
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "menclose", "msub",
    "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "semantics", "annotation", "annotation-xml", "maction",
}
# A start of the first kind ends an open element of the second kind, if no element of the third is between.
_LISTS = {"ul", "ol", "menu"}
CLOSES = {"li": ({"li"}, _LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"})}


@dataclass
class Block:
    path: list[tuple[str, tuple[str, ...]]]
    text: str
    link_share: float
    label: int = field(default=-1)


def _names(attributes: str) -> tuple[str, ...]:
    out: list[str] = []
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out.append("hidden")
            elif key != "style":
                out += [p.lower() for p in _PIECE.findall(value)]
    return tuple(dict.fromkeys(out))


@dataclass
class Tag:
    start: int
    end: int
    closing: bool = False
    name: str = ""
    attributes: str = ""


class _Tags:
    """Finds tags in time that grows with the page, also where many never end.

    A tag ends at the first ``>`` outside of quotes. Which one that is depends only on the next ``>`` or quote behind its
    name, so it is worked out once for each of these.
    """

    def __init__(self, page: str):
        self.page = page
        self.places: list[int] | None = None
        self.same: dict[str, list[int]] = {}
        self.ends: dict[int, int] = {}

    def _end(self, at: int) -> int:
        if self.places is None:
            self.places = [m.start() for m in _SPECIAL.finditer(self.page)]
            for p in self.places:
                self.same.setdefault(self.page[p], []).append(p)
        passed, end = [], -1
        while True:
            i = bisect_left(self.places, at)
            if i == len(self.places):
                break
            p = self.places[i]
            if p in self.ends:
                end = self.ends[p]
                break
            passed.append(p)
            if self.page[p] == ">":
                end = p
                break
            own = self.same[self.page[p]]
            j = bisect_right(own, p)
            if j == len(own):
                break
            at = own[j] + 1
        self.ends.update(dict.fromkeys(passed, end))
        return end

    def next(self, at: int) -> Tag | None:
        while m := _START.search(self.page, at):
            if not m[2]:
                return Tag(m.start(), m.end())
            if m[3] is not None:
                return Tag(m.start(), m.end(), bool(m[1]), m[2].lower(), m[3])
            end = self._end(m.end())
            if end >= 0:
                return Tag(m.start(), end + 1, bool(m[1]), m[2].lower(), self.page[m.end() : end])
            at = m.end()  # not a tag: text
        return None


def _raw_end(page: str, name: str, at: int) -> int:
    start = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
    end = page.find(">", start.end()) if start else -1
    return end + 1 if end >= 0 else len(page)


def _silent_ends(page: str, tags: _Tags) -> dict[int, int]:
    """Where the silent elements that are not raw end, by the end of their start tag; those never closed are left out."""
    ends: dict[int, int] = {}
    started: dict[str, list[int]] = {}
    at = 0
    while m := tags.next(at):
        at = m.end
        if m.name not in SILENT:
            continue
        if m.closing:
            if started.get(m.name):
                ends[started[m.name].pop()] = at
        elif not m.attributes.rstrip().endswith("/"):
            if m.name in RAW:
                at = _raw_end(page, m.name, at)
            else:
                started.setdefault(m.name, []).append(at)
    return ends


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order. White space inside a block is one space; references are decoded."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link_chars = links = 0
    silent_ends: dict[int, int] | None = None
    tags, open_names = _Tags(page), Counter()

    def flush():
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block([e for e in stack if e[0] not in INLINE], text, min(1.0, link_chars / len(text))))
            parts.clear()
        link_chars = 0

    def pop(to: int):
        nonlocal links
        if any(e[0] not in INLINE for e in stack[to:]):
            flush()
        links -= sum(e[0] == "a" for e in stack[to:])
        open_names.subtract(e[0] for e in stack[to:])
        del stack[to:]

    at, n = 0, len(page)
    while at < n:
        m = tags.next(at)
        text = page[at : m.start if m else n]
        if text:
            parts.append(text)
            if links:
                link_chars += len(text.strip())
        if not m:
            break
        at, name = m.end, m.name
        if not name:
            if page.startswith("<![CDATA[", m.start):
                parts.append(html.escape(page[m.start + 9 : m.end].removesuffix("]]>")))
            continue
        if m.closing:
            if open_names[name] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        pop(i)
                        break
            elif name == "p":
                flush()
            continue
        if name in SILENT:
            if name not in INLINE:
                flush()
            if not m.attributes.rstrip().endswith("/"):
                if name in RAW:
                    at = _raw_end(page, name, at)
                else:
                    if silent_ends is None:
                        silent_ends = _silent_ends(page, tags)
                    at = silent_ends.get(at, at)
            continue
        if name not in INLINE:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] not in INLINE:
                    break
            if name in CLOSES:
                same, border = CLOSES[name]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in same:
                        pop(i)
                        break
                    if stack[i][0] in border:
                        break
        if name not in VOID and not m.attributes.rstrip().endswith("/"):
            links += name == "a"
            open_names[name] += 1
            stack.append((name, _names(m.attributes)))
    flush()
    return out
