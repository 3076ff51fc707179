"""Registered queries over the stored tables and the SQL that checks each of them."""

from __future__ import annotations

from importlib import import_module

MODULES = ["cleaning", "kpis", "reports", "shapes"]


def load() -> dict:
    """All registered queries by name."""
    from outagelens.registry.core import QUERIES

    for module in MODULES:
        import_module(f"outagelens.registry.{module}")
    return QUERIES
