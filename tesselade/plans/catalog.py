"""All named queries of the core library."""

from __future__ import annotations

import importlib

MODULES = ("nested_queries", "text_queries", "review_queries", "target_queries", "eval_queries", "extra_queries")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"tesselade.plans.{name}"), attribute)
        clash = merged.keys() & part.keys()
        if clash:
            raise ValueError(f"defined twice: {sorted(clash)}")
        merged |= part
    return merged


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
