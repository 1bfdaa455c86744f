"""Markdown of small result tables."""

from __future__ import annotations

from collections.abc import Iterable


def cell(value: object) -> str:
    """Three decimals for floats, N/A for null."""
    return "N/A" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def markdown_table(rows: Iterable[dict], columns: list[str]) -> str:
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows)])


def evaluation_report(title: str, summary: dict, criteria: Iterable[dict], errors: Iterable[dict]) -> str:
    """Overall figures, criteria and errors of one evaluation."""
    head = [f"# {title}", "", "## Overall", ""] + [f"- {k}: {cell(v)}" for k, v in summary.items()]
    parts = [("Criteria", criteria, ["criterion", "precision", "recall", "f1"]), ("Errors", errors, ["error_type", "n"])]
    return "\n".join([*head, *(x for name, rows, columns in parts for x in ("", f"## {name}", "", markdown_table(rows, columns)))]) + "\n"


def ranking_report(rows: Iterable[dict]) -> str:
    """Checkpoints best first; the best one is named above the table."""
    ranked = sorted(rows, key=lambda r: r["rank"])
    best = f"Best: {ranked[0]['path']}" if ranked else "Best: N/A"
    return "\n".join(["# Checkpoints", "", best, "", markdown_table(ranked, ["rank", "path", "overall_accuracy", "overall_macro_f1", "json_parse_rate", "rouge_l", "meteor"])]) + "\n"


def throughput(samples: int, seconds: float, total: int | None = None) -> dict[str, float | None]:
    """Seconds a sample, samples a second, and the seconds that ``total`` still needs."""
    each = seconds / samples if samples else None
    left = each * (total - samples) if each is not None and total is not None else None
    return {"wall_time_sec": seconds, "sec_per_sample": each, "samples_per_sec": samples / seconds if seconds else None, "eta_sec": left}
