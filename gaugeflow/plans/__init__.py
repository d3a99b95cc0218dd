"""Registered queries: each operator on views of the driver's tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from .registry import QUERIES, Query

MODULES = ("cleaning", "series", "features", "labels", "matching", "verification", "calibration", "happenings", "outlooks", "live", "learning")


def load_queries() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES
