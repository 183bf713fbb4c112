"""Registered queries over the driver's tables, each next to its SQL check."""

from __future__ import annotations

import importlib

PARTS = ("sources", "cleaning", "indicators", "sessions", "text", "macro", "backtests", "monitoring", "drift", "models", "stores", "streaming")


def load():
    """Import every part and return (queries, SQL checks)."""
    from marketloom.catalog.registry import CHECKS, QUERIES

    for part in PARTS:
        importlib.import_module(f"marketloom.catalog.{part}")
    return QUERIES, CHECKS
