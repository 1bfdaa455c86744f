"""A structure tree over token places and its packing into pieces."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np

# Boundary levels, strongest first; a node of one level is cut into those below.
LEVELS = ("heading 1", "heading 2", "heading 3", "heading 4", "heading 5", "heading 6", "paragraph", "item", "line", "sentence", "word", "character", "token")
_HEADING = re.compile(rb"(?m)^(?:[ \t]{0,3}(#{1,6})[ \t]|<h([1-6])\b)")
_RULED = re.compile(rb"(?m)^[^\r\n]+\r?\n(=+|-+)[ \t]*\r?$")
_PARAGRAPH = re.compile(rb"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)\s*")
_ITEM = re.compile(rb"(?m)^[ \t>]*(?:[-*+]|\xe2\x80\xa2|\(?\d{1,3}[.)]|<li\b|<tr\b)[ \t*_]?|[}\]],(?=\s*[{\[\"])")
_LINE = re.compile(rb"(?:\r\n|\n|\r)")
_SENTENCE = re.compile(rb"[.!?][\"')\]*_]*(?=\s)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|[;,](?=\s*\")")
_WORD = re.compile(rb"\s+")
_FENCE = re.compile(rb"(?m)^[ \t]{0,3}(```|~~~)[^\r\n]*(?:\r?\n|\r|\Z)")
_TABLE = re.compile(rb"(?m)(?:^[ \t]*\|[^\r\n]*(?:\r?\n|\r|\Z)){2,}")
_JSON = re.compile(rb"\s*[{\[]\s*[\"{\[\d\]}tfn-]")
_NESTED = re.compile(rb'"(?:[^"\\]|\\.)*"|[{}\[\],]', re.S)


def fences(raw: bytes) -> list[tuple[int, int]]:
    """(start, end) of the code blocks, their fences included."""
    found: list[tuple[int, int]] = []
    opened: tuple[int, bytes] | None = None
    for m in _FENCE.finditer(raw):
        if opened is None:
            opened = m.start(), m.group(1)
        elif m.group(1) == opened[1]:
            found.append((opened[0], m.end()))
            opened = None
    return found + [(opened[0], len(raw))] if opened else found


def _members(raw: bytes) -> list[tuple[int, int]]:
    """(level, offset) behind the commas of a JSON text, by depth."""
    depth, found = 0, []
    for m in _NESTED.finditer(raw):
        c = m.group()
        if c in b"{[":
            depth += 1
        elif c in b"}]":
            depth -= 1
        elif c == b"," and depth > 0:
            found.append((min(5 + depth, 8), m.end()))
    return found


def boundaries(raw: bytes, starts: np.ndarray) -> dict[int, int]:
    """Strongest level of every token place that begins something."""
    found: dict[int, int] = {}
    n = len(starts)

    def mark(level: int, *offsets: int) -> None:
        for o in offsets:  # the first offset that is the start of a token
            i = int(np.searchsorted(starts, o))
            if i < n and starts[i] == o:
                if 0 < i and found.get(i, 99) > level:
                    found[i] = level
                return

    blocks = fences(raw)
    begins = [a for a, _ in blocks]

    def coded(offset: int) -> bool:
        """Inside a code block, where only blank and other lines are boundaries."""
        at = bisect_right(begins, offset) - 1
        return at >= 0 and blocks[at][0] < offset < blocks[at][1]

    for a, b in [*blocks, *(m.span() for m in _TABLE.finditer(raw) if not coded(m.start()))]:
        mark(6, a)
        mark(6, b)
    if _JSON.match(raw):
        for level, offset in _members(raw):
            mark(level, offset)
    for m in _HEADING.finditer(raw):
        if coded(m.start()):
            continue
        mark((len(m.group(1)) if m.group(1) else int(m.group(2))) - 1, m.start())
    for m in _RULED.finditer(raw):
        if coded(m.start()):
            continue
        mark(0 if m.group(1)[:1] == b"=" else 1, m.start())
    for m in _PARAGRAPH.finditer(raw):
        mark(7 if coded(m.start()) else 6, m.end(), m.start())
    for m in _ITEM.finditer(raw):
        if coded(m.start()):
            continue
        mark(7, m.end() if m.group()[:1] in b"}]" else m.start())
    for m in _LINE.finditer(raw):
        mark(8, m.end(), m.start())
    for m in _SENTENCE.finditer(raw):
        mark(9, m.end())
    return found


def fine_boundaries(raw: bytes, starts: np.ndarray, low: int, high: int) -> dict[int, int]:
    """Words, characters and tokens between two token places."""
    found = dict.fromkeys(range(low + 1, high), 12)
    for i in range(low + 1, high):
        o = int(starts[i])
        if raw[o] in b" \t\r\n" or raw[o - 1] in b" \t\r\n":
            found[i] = 10
        elif not 0x80 <= raw[o] < 0xC0:
            found[i] = 11
    return found


def pack(raw: bytes, lengths: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of the pieces, in token places.

    Units hold at most ``limit - overlap`` tokens and cover the text without
    gaps; a piece is a unit with the ``overlap`` tokens before it. ``boundary``
    names what the piece's end stands at.
    """
    total = len(lengths)
    if total <= limit:
        return [(0, total, "end")] if total else []
    most = limit - overlap
    ends = np.cumsum(lengths)
    starts = ends - lengths
    marks = boundaries(raw, starts)
    by_level: list[list[int]] = [[] for _ in LEVELS]
    for place, level in sorted(marks.items()):
        by_level[level].append(place)

    def cut(low: int, high: int, level: int, fine: list[list[int]] | None) -> list[tuple[int, int]]:
        """Units of an oversized node, from the boundaries of its level down.

        Only oversized children are cut; their last unit and the children after
        it are merged as long as they fit.
        """
        while level < len(LEVELS):
            if level == 10 and fine is None:
                fine = [[] for _ in LEVELS]
                for place, at in fine_boundaries(raw, starts, low, high).items():
                    fine[at].append(place)
            source = (fine or by_level)[level] if level >= 10 else by_level[level]
            inner = source[bisect_right(source, low) : bisect_left(source, high)]
            if inner:
                break
            level += 1
        edges = [low, *inner, high]
        units: list[tuple[int, int]] = []
        for a, b in zip(edges, edges[1:]):
            if b - a > most:
                units.extend(cut(a, b, level + 1, fine))
            elif units and b - units[-1][0] <= most:
                units[-1] = (units[-1][0], b)
            else:
                units.append((a, b))
        return units

    units = cut(0, total, 0, None)
    i = 0
    while i < len(units):
        # A unit with less of its own than a piece shares joins a neighbour that has room, over the weaker boundary.
        a, b = units[i]
        sides = []
        if b - a < overlap and i and b - units[i - 1][0] <= most:
            sides.append((marks.get(a, 99), i - 1))
        if b - a < overlap and i + 1 < len(units) and units[i + 1][1] - a <= most:
            sides.append((marks.get(b, 99), i))
        if sides:
            i = max(sides)[1]
            units[i : i + 2] = [(units[i][0], units[i + 1][1])]
        else:
            i += 1
    while len(units) > 1 and units[0][1] < overlap:  # the first piece must hold what the second shares
        units[:2] = [(0, units[1][1])]
    named = [LEVELS[marks[b]] if b in marks else None for _, b in units]
    pieces = []
    for (a, b), name in zip(units, named):
        if name is None and b < total:
            name = LEVELS[fine_boundaries(raw, starts, b - 1, b + 1)[b]]
        pieces.append((max(0, a - overlap), b, name or "end"))
    return pieces
