"""Queries of the point-cloud engine and their SQL twins, by name."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

_MODULES = [import_module(f"{__name__}.{m.name}") for m in iter_modules(__path__) if m.name.startswith("q_")]

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
