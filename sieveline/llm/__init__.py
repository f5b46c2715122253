"""Operators that prepare training data. Nothing outside this package imports it.

Each problem's module is imported on its own: where a library it needs isn't installed, its queries are left out and
MISSING names what lacks; any other error is one.
"""

from __future__ import annotations

import importlib

MODULES = ("dedup_format", "dedup_history", "credentials", "generated", "terms", "tokenize", "mixing", "sentences")
MISSING: dict[str, str] = {}
_loaded = []
for _name in MODULES:
    try:
        _loaded.append(importlib.import_module(f"{__name__}.{_name}"))
    except ModuleNotFoundError as _error:
        if (_error.name or "").split(".")[0] == "sieveline":
            raise
        MISSING[_name] = _error.name or ""


def queries() -> dict:
    return {k: v for m in _loaded for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _loaded for k, v in getattr(m, "SQL", {}).items()}
