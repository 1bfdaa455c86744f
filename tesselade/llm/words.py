"""Text as it is compared: one normalisation for all operators on words."""

from __future__ import annotations

import re
import unicodedata

_HIDDEN = frozenset(c for c in map(chr, [*range(0x10000), *range(0xE0000, 0xE0100)]) if c not in "\t\n\r" and unicodedata.category(c) in ("Cf", "Cc", "Cs", "Cn", "Co"))
_HIDDEN_CLASS = re.compile("[" + "".join(map(re.escape, sorted(_HIDDEN))) + "]")
WORD = re.compile(r"[^\W_]+")
WIDE = "ᄀ-ᇿ぀-ヿ㐀-䶿一-鿿가-힯฀-๿"
_UNIT = re.compile(f"[{WIDE}]|[^\\W_{WIDE}]+")


def visible(text: str | None) -> str:
    """Text without invisible and control characters, blanks as stored."""
    if not text:
        return ""
    return text if text.isascii() and text.isprintable() or _HIDDEN.isdisjoint(set(text)) else _HIDDEN_CLASS.sub("", text)


def folded(text: str) -> str:
    """Composed, compatibility forms replaced, case folded."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())


def words(text: str | None) -> list[str]:
    """Runs of letters or digits."""
    return WORD.findall(folded(visible(text)))


def units(text: str) -> list[str]:
    """Words; a character each in scripts without blanks."""
    return _UNIT.findall(folded(text))
