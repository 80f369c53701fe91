"""Queries by name.  Importing the modules below registers them."""

from __future__ import annotations

import importlib

from .catalog import ORACLES, QUERIES

MODULES = ["text", "relational", "scalars", "filtering", "flows", "shared", "indexes", "upkeep", "varied", "packages", "projects"]


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def oracles() -> dict:
    _load()
    return dict(ORACLES)
