"""Registered queries: operators applied to tables, each with SQL that gives the same rows."""

from __future__ import annotations

import importlib
import pkgutil


def load() -> None:
    """Import every module of queries, which registers them."""
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")):
        importlib.import_module(f"{__name__}.{module}")
