"""Registered queries: operators applied to the driver's tables.

Dates leave as ISO text and counts as integers, so that results compare across engines.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from workweave.plans.registry import QUERIES

_MODULES = ("absences", "edits", "calls", "web", "streams", "files")


def registry() -> dict[str, Callable]:
    for name in _MODULES:
        importlib.import_module(f"workweave.plans.{name}")
    return dict(QUERIES)
