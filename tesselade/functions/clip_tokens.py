"""Text as the fixed-length ids that an image-text encoder reads."""

from __future__ import annotations

import html
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 77  # context of the encoder


@lru_cache(2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def clip_tokens(value: Column, path: str = "/opt/tokenizers/word_bpe_49k.json", length: int = LENGTH) -> Column:
    """array<int> of ``length``: start, ids, end, zeros.

    Entities are resolved twice, blanks run together, case is lowered by the
    vocabulary. A longer text keeps its first ids and the end mark; null is
    like an empty text.
    """

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        t = _tokenizer(path)
        first, last = t.token_to_id("<|startoftext|>"), t.token_to_id("<|endoftext|>")
        bare = [" ".join(html.unescape(html.unescape(x or "")).split()) for x in texts]
        out = []
        for e in t.encode_batch(bare, add_special_tokens=False):
            ids = [first, *e.ids[: length - 2], last]
            out.append(ids + [0] * (length - len(ids)))
        return pd.Series(out, dtype=object)

    return run(value)
