"""Words of a text without its layout, and the exact check of a passage."""

from __future__ import annotations

import html
import re

from tesselade.llm.words import WORD, folded, visible

_ESCAPE = re.compile(r"\\+(?:u([0-9a-fA-F]{4})|([nrtbf])|([\"/'\\]))")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|br|hr|div|li|ul|ol|td|th|tr|table|tbody|thead|h[1-6]|section|article|pre|blockquote)\b[^<>]*>", re.I)
_INLINE_TAG = re.compile(r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?/?>")
_LINK = re.compile(r"\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
_INSIDE = re.compile(r"(?<=\w)[*`~]+(?=\w)")


def _unescape(m: re.Match[str]) -> str:
    code, blank, mark = m.groups()
    return chr(int(code, 16)) if code else " " if blank else mark


def readings(text: str | None) -> list[list[str]]:
    """Words of a text without escapes, tags, comments, link targets and hidden
    marks; and its words with the content of these, where that is more.

    A passage may stand in a comment or an attribute as well as around one.
    """
    if not text:
        return [[]]
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    text = folded(visible(text))
    plain = text
    if "<" in plain:
        if "<!--" in plain and "-->" in plain:
            plain = _COMMENT.sub(" ", plain)
        if ">" in plain:
            plain = _INLINE_TAG.sub("", _BLOCK_TAG.sub(" ", plain))
    if "](" in plain:
        plain = _LINK.sub(" ", plain)
    if "*" in plain or "`" in plain or "~" in plain:
        plain = _INSIDE.sub("", plain)
    found = [WORD.findall(plain)]
    if plain != text and (whole := WORD.findall(text)) != found[0]:
        found.append(whole)
    return found


def words(text: str | None) -> list[str]:
    return readings(text)[0]


def runs(same: list[bool], least: int, share: int = 10) -> list[tuple[int, int]]:
    """The longest run that ``holds`` finds, and those left and right of it."""
    best = holds(same, least, share)
    if best is None:
        return []
    start, end = best
    right = [(a + end, b + end) for a, b in runs(same[end:], least, share)]
    return [*runs(same[:start], least, share), best, *right]


def holds(same: list[bool] | bytes, least: int, share: int = 10) -> tuple[int, int] | None:
    """A run of at least ``least`` places with one in ``share`` differing.

    ``same`` says for places along one alignment whether the words agree.
    Returns (start, end) of the longest such run from its earliest start that
    begins and ends with agreeing words, or None.
    """
    n = len(same)
    if n < least:
        return None
    # score of a run: +1 an agreeing word, -(share - 1) a differing one; it fits if the score is not negative
    prefix = [0] * (n + 1)
    for i, ok in enumerate(same):
        prefix[i + 1] = prefix[i] + (1 if ok else 1 - share)
    best = None
    lowest: list[int] = []  # places of falling prefix minima
    for i in range(n + 1):
        if not lowest or prefix[i] < prefix[lowest[-1]]:
            lowest.append(i)
    for end in range(n, 0, -1):
        while lowest and prefix[lowest[-1]] <= prefix[end]:
            start = lowest.pop()
            if end - start >= least and (best is None or end - start > best[1] - best[0]):
                best = (start, end)
    return best
