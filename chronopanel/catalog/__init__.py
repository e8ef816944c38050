"""Registered queries, one module per operator group."""

from __future__ import annotations

import importlib

MODULES = ("trading", "scalars", "scans", "calendar", "joins", "aggregates", "timeseries", "selectors", "grids", "inference", "modelling", "streams")


def load():
    from chronopanel.catalog import registry
    for name in MODULES:
        importlib.import_module(f"chronopanel.catalog.{name}")
    return registry.QUERIES, registry.ORACLES
