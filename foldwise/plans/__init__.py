"""Named queries over the test tables, each beside the SQL it is checked against."""

from __future__ import annotations

import importlib

MODULES = [
    "enrichment", "reshape", "gates", "joins", "summaries", "additivity", "normalise", "sampling", "diagnostics", "models", "sources",
]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"foldwise.plans.{name}")
