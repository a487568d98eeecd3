"""Registered queries, one module for each family of operators."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every module of this package, so that its queries register themselves."""
    for info in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{info.name}")
