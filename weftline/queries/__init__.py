"""Registered queries over the driver's tables, by module, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

MODULES = ("pairs", "tables", "graphs", "series", "more")

QUERIES: dict = {}
ORACLES: dict = {}
for _name in MODULES:
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark, sf_dir):
    """Jaccard similarity of brands bought together, by order priority."""
    return QUERIES["m1_jaccard"](spark, sf_dir)
