"""Token ids of whole texts by a public byte-level tokenizer."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselade.llm.bpe import encoder

DEFAULT_DIR = "/opt/tokenizers"
# Fixed value: the split of a text into pre-tokens that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_MODEL_BYTES = 64 << 20  # a vocabulary is broadcast; a larger file is refused


def vocabulary(df: DataFrame, name: str = "byte_bpe_50k", folder: str | None = None) -> Broadcast:
    """The tokenizer's file, shipped once to every executor.

    ``folder`` defaults to the installed public_tokenizers, then to
    ``DEFAULT_DIR``.
    """
    if folder is None:
        spec = None if os.path.isdir(DEFAULT_DIR) else importlib.util.find_spec("public_tokenizers")
        folder = DEFAULT_DIR if spec is None else os.path.dirname(spec.origin)
    path = os.path.join(folder, f"{name}.json")
    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} is too large to broadcast")
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text, without special tokens.

    A null and an empty text give an empty list, blanks are tokens. Every row
    gives a row: repeated rows and null keys stay. Strings of special tokens
    are ordinary text.
    """
    model = vocabulary(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(model.value, PATTERN)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            values = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["key", "ids"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, ids array<int>").withColumnRenamed("key", key)
