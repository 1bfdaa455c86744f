"""Queries on tokens: ids and pieces."""

from __future__ import annotations

from tesselade.llm.encode import encode
from tesselade.llm.splitting import pieces
from tesselade.session import table


def p6_ids(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_found(spark, sf_dir):
    return pieces(table(spark, sf_dir, "documents"), "doc_id", "text", content=False).where("piece = 1").select("doc_id")


def p8_pieces(spark, sf_dir):
    return pieces(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p6_ids": p6_ids, "p8_found": p8_found, "p8_pieces": p8_pieces}
ORACLE: dict[str, str] = {}
