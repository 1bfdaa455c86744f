"""Normalised records, content-defined chunks and the exact check of a pair."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import xxhash

from tesselade.llm.words import WORD, folded, visible

_NUMBER = re.compile(r"(?:(?<=\s)|^)[*_#>(\[\- ]*\d{1,2}\s*[.)\]:、](?=\s|[*_])")
_SENTENCE = re.compile(r"[.!?;。！？；](?=\s|$|[*_\"')\]])|[\r\n]+")
BEFORE, AFTER = 1, 2  # words beside a cut that stand in its chunk


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence; numbers of items are left out."""
    shown = _NUMBER.sub(" ", folded(visible(text)))
    return [w for s in _SENTENCE.split(shown) if (w := WORD.findall(s))]


@lru_cache(1 << 17)
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _cut(words: list[str], h: list[int], places: Iterable[int]) -> Iterator[tuple[int, int, int]]:
    n = len(words)
    for i in places:
        if (i == 0 or h[i] < h[i - 1]) and (i == n - 1 or h[i] <= h[i + 1]):
            start, end = i - BEFORE, i + AFTER + 1
            if start < 0 or end > n:
                content = f"{min(0, start)} {' '.join(words[max(0, start) : end])} {min(0, n - end)}"
            else:
                content = " ".join(words[start:end])
            yield xxhash.xxh3_64_intdigest(content), max(0, start), min(n, end)


def chunks(words: list[str]) -> list[tuple[int, int, int]]:
    """(digest, start, end) of the content-defined chunks, which overlap.

    Local minima of the rolling word hashes cut, one in three words or so. The
    chunk of a cut has the word before it and the two after it, with a mark
    where the text ends, and holds all words that make the cut. As two minima
    are never neighbours, an edit of one word, wherever it stands, destroys at
    most two chunks and moves no other.
    """
    return list(_cut(words, [_hash(w) for w in words], range(len(words))))


def views(said: list[list[str]]) -> tuple[list[int], list[int]]:
    """Digests of the chunks within sentences and of those of the whole text.

    A chunk that no sentence end clips is one of the whole text, too.
    """
    within: list[int] = []
    whole: list[int] = []
    words = [w for s in said for w in s]
    hashes = [_hash(w) for w in words]
    begin = 0
    for s in said:
        n = len(s)
        for digest, start, end in _cut(s, hashes[begin : begin + n], range(n)):
            within.append(digest)
            if end - start == BEFORE + AFTER + 1:
                whole.append(digest)
        edges = sorted({0, *range(max(0, n - AFTER), n)})
        whole += [d for d, _, _ in _cut(words, hashes, (begin + i for i in edges))]
        begin += n
    return within, whole


def word_counts(words: list[str], longs: int) -> list[int]:
    """Counts of the words by hash, modulo 4 and in Gray code, 32 to a number.

    One word more or less turns one bit, so an edit turns at most two.
    """
    counts = Counter(_hash(w) % (32 * longs) for w in words)
    parts = [0] * longs
    for place, n in counts.items():
        parts[place // 32] |= (n & 3 ^ (n & 3) >> 1) << 2 * (place % 32)
    return [p - (1 << 64) if p >> 63 else p for p in parts]


def edits(a: list[str], b: list[str]) -> int:
    """Word edit distance, bit-parallel over b."""
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | (1 << i)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for w in b:
        eq = places.get(w, 0)
        x = eq | minus
        d = ((((eq & plus) + plus) ^ plus) | eq) & full
        up, down = minus | (~(d | plus) & full), plus & d
        score += bool(up & top) - bool(down & top)
        up = ((up << 1) | 1) & full
        down = (down << 1) & full
        plus, minus = down | (~(x | up) & full), up & x
    return score


def differing(a: list[list[str]], b: list[list[str]], limit: int) -> int:
    """Words changed, added or dropped, the order of sentences aside.

    Equal sentences cancel out; the others are matched by fewest edits. A
    record that lost its sentence ends is compared as one sequence. A result
    above ``limit`` only says that there are more.
    """
    left, right = Counter(w for s in a for w in s), Counter(w for s in b for w in s)
    least = max(sum((left - right).values()), sum((right - left).values()))
    if least > limit:
        return least
    whole = edits([w for s in a for w in s], [w for s in b for w in s])
    if whole <= limit:
        return whole
    mine, other = Counter(map(tuple, a)), Counter(map(tuple, b))
    rest_a, rest_b = [list(s) for s in (mine - other).elements()], [list(s) for s in (other - mine).elements()]
    if 2 * min(len(a), len(b)) < max(len(a), len(b)):
        return least  # sentence ends are lost on one side: their order can't be told
    total = 0
    for s in sorted(rest_a, key=len, reverse=True):
        if not rest_b:
            total += len(s)
            continue
        at, cost = min(((i, edits(s, t)) for i, t in enumerate(rest_b)), key=lambda x: x[1])
        if cost >= len(s) + len(rest_b[at]):
            total += len(s)
        else:
            total += cost
            rest_b.pop(at)
    return min(whole, total + sum(map(len, rest_b)))
