"""Registered queries, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil


def load_catalog() -> dict:
    """Import every module of this package and return the filled catalog."""
    from oddsloom.plans.registry import CATALOG

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{module}")
    return CATALOG
