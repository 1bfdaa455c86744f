"""Nested settings with dotted names, and small parsers of option values."""

from __future__ import annotations

import json
import os
from typing import Any

from tesselade.dims import TASK_MIX


class Settings:
    """A nested dict read by names such as ``training.lr``."""

    def __init__(self, values: dict | None = None):
        self.values = values or {}

    @classmethod
    def load(cls, path: str) -> Settings:
        """From JSON, or from YAML where its library is installed."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return cls(yaml.safe_load(f))
            return cls(json.load(f))

    def get(self, name: str, default: Any = None) -> Any:
        found: Any = self.values
        for part in name.split("."):
            if not isinstance(found, dict) or part not in found:
                return default
            found = found[part]
        return found

    def set(self, name: str, value: Any) -> None:
        *above, last = name.split(".")
        at = self.values
        for part in above:
            if not isinstance(at.get(part), dict):
                at[part] = {}
            at = at[part]
        at[last] = value

    def override(self, values: dict[str, Any]) -> None:
        """Sets what is given; None and empty strings leave things as they are."""
        for name, value in values.items():
            if value is not None and value != "":
                self.set(name, value)

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, ensure_ascii=False, indent=2)


def task_mix(text: str | None) -> dict[str, float]:
    """Weights from JSON or ``a=1,b=2``; the default mix for nothing."""
    if not text:
        return dict(TASK_MIX)
    try:
        return {k: float(v) for k, v in json.loads(text).items()}
    except json.JSONDecodeError:
        pairs = (part.split("=", 1) for part in text.split(",") if part.strip())
        return {k.strip(): float(v) for k, v in pairs}


def retry_budget(tokens: int) -> int:
    """Tokens of a second attempt at a trace that didn't parse."""
    return min(3072, max(tokens + 1024, 2 * tokens))
