"""Every registered query beside the SQL that states it: bindings of the library to the given tables."""

from __future__ import annotations

import importlib

MODULES = ("functions", "rules", "retrieval", "shapes", "assembly", "builds")


def _gathered(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"sparkwell.catalog.{m}"), name)
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def sql() -> dict:
    return _gathered("SQL")
