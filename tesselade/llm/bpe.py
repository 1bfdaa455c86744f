"""Byte-level BPE with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Every adjacent pair that can merge lies
in the bucket of its merge rank; a two-level bitmap over the ranks gives the
lowest rank in use by two find-first-set steps, whatever the length of the
pre-token. Merging unlinks the right token and files the two new pairs;
entries that a merge made stale are skipped when their bucket comes up.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import regex

WIDTH = 256  # bits in a word of either bitmap level


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Cache(dict):
    """Ids by piece; cleared when full, which costs time and no result."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece):
        if len(self) >= self.most:
            self.clear()
        ids = self[piece] = self.encode(piece)
        return ids


class ByteBPE:
    """An encoder of one vocabulary; ``model`` is the tokenizer's JSON text."""

    def __init__(self, model: str | bytes, pattern: str, cache: int = 500_000):
        parts = json.loads(model)["model"]
        alphabet, vocab = _byte_alphabet(), parts["vocab"]
        self.pattern = regex.compile(pattern)
        self.first = [0] * 256
        for c, b in alphabet.items():
            self.first[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}
        joined: set[int] = set()
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        for rank, pair in enumerate(parts["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = vocab[left], vocab[right]
            self.merges[a << 32 | b] = (rank, vocab[left + right])
            joined.add(self.bytes_of[a][-1] << 8 | self.bytes_of[b][0])
        self.joined = joined
        self.words = len(self.merges) // WIDTH + 1
        self.segments = _Cache(self._queue, cache)
        self.pieces = _Cache(self._piece, cache)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.pattern.findall(text)))) if text else []

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) < 16 or piece.isascii():
            return self._queue(raw)
        # No merge joins these two bytes, so what lies on either side is encoded on its own.
        joined, start, ids = self.joined, 0, []
        for i in range(1, len(raw)):
            if raw[i] >= 0xC0 and (raw[i - 1] << 8 | raw[i]) not in joined:
                ids.extend(self.segments[raw[start:i]])
                start = i
        ids.extend(self.segments[raw[start:]])
        return tuple(ids)

    def _queue(self, raw: bytes) -> tuple[int, ...]:
        merges = self.merges
        token = [self.first[b] for b in raw]
        n = len(token)
        if n == 1:
            return tuple(token)
        low, high = [0] * self.words, 0
        buckets: dict[int, list[int]] = {}
        for i in range(n - 1):
            found = merges.get(token[i] << 32 | token[i + 1])
            if found:
                rank = found[0]
                at = buckets.get(rank)
                if at is None:
                    buckets[rank] = [i]
                    low[rank >> 8] |= 1 << (rank & 255)
                    high |= 1 << (rank >> 8)
                else:
                    at.append(i)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while high:
            word = (high & -high).bit_length() - 1
            bits = low[word]
            rank = word << 8 | ((bits & -bits).bit_length() - 1)
            bits &= bits - 1
            low[word] = bits
            if not bits:
                high &= ~(1 << word)
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            for i in places:
                left, j = token[i], after[i]
                if left < 0 or j >= n:
                    continue  # stale: merged into its left neighbour, or last
                found = merges.get(left << 32 | token[j])
                if found is None or found[0] != rank:
                    continue  # stale: another pair stands here now
                new = token[i] = found[1]
                token[j] = -1
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    found = merges.get(new << 32 | token[k])
                    if found:
                        high = self._file(buckets, low, high, found[0], i)
                h = before[i]
                if h >= 0:
                    found = merges.get(token[h] << 32 | new)
                    if found:
                        high = self._file(buckets, low, high, found[0], h)
        return tuple(t for t in token if t >= 0)

    @staticmethod
    def _file(buckets: dict[int, list[int]], low: list[int], high: int, rank: int, place: int) -> int:
        at = buckets.get(rank)
        if at is None:
            buckets[rank] = [place]
            low[rank >> 8] |= 1 << (rank & 255)
            return high | 1 << (rank >> 8)
        at.append(place)
        return high


@lru_cache(2)
def encoder(model: bytes, pattern: str) -> ByteBPE:
    """One encoder a Python worker and vocabulary."""
    return ByteBPE(model, pattern)
