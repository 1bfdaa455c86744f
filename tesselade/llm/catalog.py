"""All named queries of this subpackage."""

from __future__ import annotations

import importlib

MODULES = ("pair_queries", "overlap_queries", "sample_queries", "term_queries", "token_queries", "leak_queries")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        merged |= getattr(importlib.import_module(f"tesselade.llm.{name}"), attribute)
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
