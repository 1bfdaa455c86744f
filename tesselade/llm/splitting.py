"""Oversized texts in pieces that end at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselade.llm.bpe import encoder
from tesselade.llm.encode import PATTERN, vocabulary
from tesselade.llm.split_text import pack

LIMIT, OVERLAP = 1000, 100


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, content: bool = True, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, piece, start_token, end_token, boundary[, text]) of oversized texts.

    Texts of at most ``limit`` tokens need no cut and give no row, null and
    empty ones included. Consecutive pieces share ``overlap`` tokens. Headings,
    paragraphs, items, lines and sentences form the tree; words, characters
    and tokens serve only where a node has nothing better. Where a shared part
    begins inside a character, ``text`` begins with the next whole one, the
    token places stay exact. Repeated rows and null keys are pieces of their
    own.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("the overlap must be less than half of the limit")
    model = vocabulary(df, name, folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(model.value, PATTERN)
        width = np.zeros(max(bpe.bytes_of) + 1, np.int64)
        for i, b in bpe.bytes_of.items():
            width[i] = len(b)
        for pdf in batches:
            out: list[tuple] = []
            for k, value in zip(pdf["key"], pdf["text"]):
                ids = bpe.encode(value)
                if len(ids) <= limit:
                    continue
                raw = value.encode("utf-8", "surrogatepass")
                lengths = width[ids]
                ends = np.cumsum(lengths)
                for p, (a, b, boundary) in enumerate(pack(raw, lengths, limit, overlap)):
                    part = raw[int(ends[a - 1]) if a else 0 : int(ends[b - 1])].decode("utf-8", "ignore") if content else None
                    out.append((k, p, a, b, boundary, part))
            yield pd.DataFrame(out, columns=["key", "piece", "start_token", "end_token", "boundary", "text"])

    # A token holds a byte at least, so a text of few bytes is never oversized.
    rows = df.where(F.octet_length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {dict(rows.dtypes)['key']}, piece int, start_token int, end_token int, boundary string, text string"
    found = rows.mapInPandas(run, schema).withColumnRenamed("key", key)
    return found if content else found.drop("text")
