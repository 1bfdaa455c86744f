"""Finding and repairing JSON in model output.

Nesting and strings are not regular, so these run in Python, an Arrow batch at
a time. Strings are matched as whole tokens by one pattern; only brackets
outside of strings are looked at.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', re.S)
_PAIR = {"{": "}", "[": "]"}
# Marks and their plain forms.
PLAIN = str.maketrans({"\ufeff": None, "‘": "'", "’": "'", "“": '"', "”": '"', "　": " "})
_NEWLINE = re.compile(r"\r\n?")
_FENCED = re.compile(r"```(?:json)?\s*(.*?)\s*(?:```\s*)?", re.S)
_PART = re.compile(r'(?P<text>"(?:[^"\\]|\\.)*(?:"|\\?\Z))|(?P<open>[{\[])|(?P<close>[}\]])|(?P<mark>[,:])|(?P<word>[^\s"{}\[\],:]+)', re.S)


def plain_json_text(text: str) -> str:
    """Without byte-order mark, typographic quotes and code fences."""
    bare = _NEWLINE.sub("\n", text.translate(PLAIN)).strip()
    fenced = _FENCED.fullmatch(bare)
    return fenced.group(1) if fenced else bare


def _scan(text: str, start: int, openers: str) -> int | None:
    """End of the value that opens at ``start``; None if it never closes.

    With one opener only its kind of bracket is counted; with both, a closer
    that fits none ends the search.
    """
    open_: list[str] = []
    for m in _TOKEN.finditer(text, start):
        c = m.group()
        if c in openers:
            open_.append(_PAIR[c])
        elif c in [_PAIR[o] for o in openers]:
            if open_[-1] != c:
                return None
            open_.pop()
            if not open_:
                return m.end()
    return None


def first_object(text: str) -> str:
    """The first ``{...}``; its tail if it never closes; else the text."""
    start = text.find("{")
    return text if start < 0 else text[start : _scan(text, start, "{")]


def first_value(text: str) -> str:
    """The first ``{...}`` or ``[...]``, else like ``first_object``."""
    found = re.search(r"[{\[]", text)
    return text[found.start() : _scan(text, found.start(), "{[")] if found else text


def closed(text: str) -> str:
    """With the quote and brackets that are missing at the end."""
    open_: list[str] = []
    cut = False
    for m in _TOKEN.finditer(text):
        c = m.group()
        if c in _PAIR:
            open_.append(_PAIR[c])
        elif c[0] != '"':
            if open_ and open_[-1] == c:
                open_.pop()
        else:
            cut = m.end() == len(text) and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', c, re.S)
    return text + '"' * cut + "".join(reversed(open_))


def rebuilt(text: str) -> str:
    """The first JSON value written anew from its tokens.

    A comma stands between two members and nowhere else, a closer that fits no
    open bracket is dropped, and what is open at the end is closed. Text after
    the value is left out; a text without bracket stays as it is. A text that
    breaks off behind a comma lost a member and keeps that comma.
    """
    start = re.search(r"[{\[]", text)
    if not start:
        return text
    out: list[str] = []
    open_: list[str] = []
    due = False  # a member is complete, so that a comma must precede the next
    token, at = "", start.start()
    for m in _PART.finditer(text, at):
        kind, token = m.lastgroup, m.group()
        gap, at = text[at : m.start()], m.end()
        if token == ",":
            continue
        if kind == "close":
            if open_[-1] != token:
                continue
            token = open_.pop()
        comma = due and kind in ("text", "word", "open")
        due = kind not in ("open", "mark")
        if kind == "open":
            open_.append(_PAIR[token])
        out += ["," * comma, gap, closed(token) if kind == "text" else token]
        if not open_:
            break
    lost = "," if open_ and token == "," else ""
    return "".join([*out, lost, *reversed(open_)])


def candidates(text: str) -> list[str]:
    """Texts to try in turn: as given, its first object, closed, rebuilt."""
    plain = plain_json_text(text)
    tried = (plain, first_object(plain), closed(first_object(plain)), rebuilt(first_object(plain)))
    return [c for c in dict.fromkeys(tried) if c]


def _reads(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


@F.pandas_udf(T.StringType())
def json_value(texts: pd.Series) -> pd.Series:
    """The first JSON value in each text if it parses, else null."""
    found = (None if t is None else first_value(t) for t in texts)
    return pd.Series([f if f is not None and _reads(f) else None for f in found], dtype=object)


@F.pandas_udf(T.StringType())
def repaired_json(texts: pd.Series) -> pd.Series:
    """The first candidate of each text that parses, else null."""
    return pd.Series([None if t is None else next((c for c in candidates(t) if _reads(c)), None) for t in texts], dtype=object)
