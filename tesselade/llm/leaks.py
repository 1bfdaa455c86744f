"""Evaluation passages inside a corpus.

The n-grams of the evaluation items are broadcast as a hash set. Token windows
of the documents are looked up in it, a hit is kept if the words around it
agree well enough, and its alignment is then checked word by word. n is chosen
so that no passage can be missed: among 20 words of which two differ, six in a
row agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselade.llm.leak_text import readings, runs, words
from tesselade.session import materialise

LEAST, SHARE = 20, 10  # words of a passage; one in SHARE may differ
NGRAM = 6  # (LEAST - LEAST // SHARE) / (LEAST // SHARE + 1)
SLACK = 4  # words that may differ in the LEAST words around a hit of a passage that fits
BLOCK_BYTES = 16 << 20  # evaluation text that is broadcast at once; more is scanned in blocks
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], np.uint64)


class _Items:
    """Word numbers of the items, laid out flat, and their n-grams by hash."""

    def __init__(self, rows: list[tuple]):
        self.vocab: dict[str, int] = {}
        self.keys, parts, self.begin, self.end = [], [], [], []
        at = LEAST
        for key, text in rows:
            said = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            if len(said) < LEAST:
                continue
            self.keys.append(key)
            self.begin.append(at)
            self.end.append(at + len(said))
            parts.append(said)
            at += len(said) + LEAST  # a gap, so that no window reaches the next item
        self.flat = np.full(at + LEAST, -1, np.int32)
        owner = np.full(at + LEAST, -1, np.int32)
        for i, said in enumerate(parts):
            self.flat[self.begin[i] : self.end[i]] = said
            owner[self.begin[i] : self.end[i] - NGRAM + 1] = i
        self.owner = owner
        places = np.flatnonzero(owner >= 0)
        codes = ngram_codes(self.flat)[places]
        order = np.argsort(codes, kind="stable")
        self.codes, first = np.unique(codes[order], return_index=True)
        self.places = places[order]
        self.first = np.append(first, len(places))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.codes >> np.uint64(44)).astype(np.int64)] = True


def ngram_codes(numbers: np.ndarray) -> np.ndarray:
    """Hash of the n-gram that begins at each place."""
    wide = numbers.astype(np.uint64)
    n = max(0, len(wide) - NGRAM + 1)
    codes = np.zeros(n, np.uint64)
    for k in range(NGRAM):
        codes = (codes ^ wide[k : k + n]) * _FACTORS[k]
        codes ^= codes >> np.uint64(32)
    return codes


@lru_cache(4)
def _items(rows: tuple) -> _Items:
    return _Items(list(rows))


def passages(items: _Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start in the text, start in the item, words) of each passage.

    Places count the words of a text's first reading; a further one gives only
    items that the first doesn't hold, at place -1.
    """
    get = items.vocab.get
    owners, said = [], []
    for i, t in enumerate(texts):
        for n, reading in enumerate(readings(t)):
            owners.append((i, n))
            said.append([get(w, 0) for w in reading])
    begin = np.cumsum([LEAST, *[len(x) + LEAST for x in said]])
    flat = np.full(int(begin[-1]) + LEAST, -2, np.int32)
    for at, x in zip(begin, said):
        flat[at : at + len(x)] = x
    codes = ngram_codes(flat)
    near = np.flatnonzero(items.maybe[(codes >> np.uint64(44)).astype(np.int64)])
    at = np.searchsorted(items.codes, codes[near])
    at[at == len(items.codes)] = 0
    hit = items.codes[at] == codes[near] if len(items.codes) else np.zeros(0, bool)
    near, at = near[hit], at[hit]
    sizes = items.first[at + 1] - items.first[at]
    found: set[tuple[int, int]] = set()
    window = np.arange(NGRAM - LEAST, LEAST)
    step = 1 << 16
    bounds = np.append(0, np.cumsum(sizes))
    low = 0
    while low < len(near):  # hits in blocks, so that memory stays bounded
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + step, "right")) - 1)
        n = sizes[low:high]
        p = np.repeat(near[low:high], n)
        q = items.places[np.repeat(items.first[at[low:high]], n) + np.arange(n.sum()) - np.repeat(bounds[low:high] - bounds[low], n)]
        # A seed whose left neighbours agree belongs to the alignment of the seed before it.
        fresh = flat[p - 1] != items.flat[q - 1]
        p, q = p[fresh], q[fresh]
        same = flat[p[:, None] + window] == items.flat[q[:, None] + window]
        sums = np.zeros((len(p), same.shape[1] + 1), np.int16)
        np.cumsum(same, axis=1, out=sums[:, 1:])
        alike = (sums[:, LEAST:] - sums[:, :-LEAST]).max(axis=1, initial=0) >= LEAST - SLACK
        found.update(zip(p[alike].tolist(), q[alike].tolist()))
        low = high
    out, seen = [], set()
    for p, q in sorted(found):
        text = int(np.searchsorted(begin, p, "right")) - 1
        item = int(items.owner[q])
        if (text, item, p - q) in seen:
            continue
        seen.add((text, item, p - q))
        left = min(p - int(begin[text]), q - items.begin[item])
        n = left + min(int(begin[text]) + len(said[text]) - p, items.end[item] - q)
        a, b = p - left, q - left
        for start, end in runs((flat[a : a + n] == items.flat[b : b + n]).tolist(), LEAST, SHARE):
            out.append((text, item, a + start - int(begin[text]), b + start - items.begin[item], end - start))
    first = {(owners[t][0], item) for t, item, *_ in out if owners[t][1] == 0}
    return [(owners[t][0], item, at if owners[t][1] == 0 else -1, start, n) for t, item, at, start, n in out if owners[t][1] == 0 or (owners[t][0], item) not in first]


def leaks(df: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(key, item, text_start, item_start, words) of every passage found.

    Places count words. A document that holds an item in several places gives
    a row each; text_start is -1 where it stands only in mark-up. Null, empty
    and short texts or items hold nothing; repeated documents are cases of their
    own, repeated items too. Evaluation text beyond ``BLOCK_BYTES`` is matched in
    blocks, a scan of the corpus each; one block at a time is on the driver.
    """
    wanted = items.where(F.col(item_text).isNotNull()).select(F.col(item_key).alias("item"), F.col(item_text).alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    rows = df.where(F.octet_length(text) >= 2 * LEAST - 1).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {dict(rows.dtypes)['key']}, item {dict(wanted.dtypes)['item']}, text_start int, item_start int, words int"
    parts = []
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b) if blocks > 1 else wanted
        shared = df.sparkSession.sparkContext.broadcast(tuple((r["item"], r["text"]) for r in block.collect()))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            known = _items(shared.value)
            for pdf in batches:
                keys, texts = pdf["key"].tolist(), pdf["text"].tolist()
                out: list[tuple] = []
                low = 0
                while low < len(texts):  # a few megabytes at a time
                    high, chars = low, 0
                    while high < len(texts) and (high == low or chars + len(texts[high]) < 1 << 21):
                        chars += len(texts[high])
                        high += 1
                    out += [(keys[low + t], known.keys[i], a, c, n) for t, i, a, c, n in passages(known, texts[low:high])]
                    low = high
                yield pd.DataFrame(out, columns=["key", "item", "text_start", "item_start", "words"])

        part = rows.mapInPandas(run, schema)
        if blocks > 1:
            part = materialise(part)
            shared.destroy()
        parts.append(part)
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    return found.withColumnRenamed("key", key)


def without_leaks(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """The documents that hold no item; rows without key are kept."""
    return df.join(found.select(key).distinct(), key, "left_anti")


def trimmed(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
    """The lines of a text that hold no word of a span (start, words).

    None where lines can't be told apart: a passage in mark-up, or mark-up
    that goes over a line end.
    """
    if not spans:
        return text
    lines = text.splitlines(keepends=True)
    counts = [len(words(x)) for x in lines]
    if any(start < 0 for start, _ in spans) or sum(counts) != len(words(text)):
        return None
    kept, at = [], 0
    for line, n in zip(lines, counts):
        if not n or all(at + n <= start or start + length <= at for start, length in spans):
            kept.append(line)
        at += n
    return "".join(kept)


def without_spans(df: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """(key, text) of all documents, without the lines that hold a passage of
    ``found``; documents of which ``trimmed`` makes nothing are left out."""
    spans = found.groupBy(key).agg(F.collect_set(F.struct("text_start", "words")).alias("spans"))
    rows = df.select(key, F.col(text).alias("text")).join(spans, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pairs = [None if s is None else [(x["text_start"], x["words"]) for x in s] for s in pdf["spans"]]
            kept = [trimmed(t, s) for t, s in zip(pdf["text"], pairs)]
            keep = [s is None or k is not None for k, s in zip(kept, pairs)]
            yield pd.DataFrame({key: pdf[key], "text": kept})[keep]

    return rows.mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, text string")
