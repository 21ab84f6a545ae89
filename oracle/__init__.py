"""Independent DuckDB statements for the registered queries."""

from __future__ import annotations

import importlib

_MODULES = ("absences", "edits", "calls", "web", "streams", "files")


def all_statements() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in _MODULES:
        found.update(importlib.import_module(f"oracle.{name}").STATEMENTS)
    return found
