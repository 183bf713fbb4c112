"""Operators for building training data, their queries and their SQL checks.

Nothing outside this subpackage imports it, except the guarded lines of ``__spark_entry__.py``.
"""

from __future__ import annotations

import importlib

PARTS = (
    "decontamination",
    "language_model",
    "neighbours",
    "ngram_join",
    "packing",
    "quality",
    "resampling",
    "sharding",
    "simhash",
    "spelling",
    "token_counts",
    "token_files",
    "url_filter",
)


def load():
    """Import every operator and return (queries, SQL checks)."""
    queries, checks = {}, {}
    for part in PARTS:
        module = importlib.import_module(f"marketloom.llm.{part}")
        queries |= module.QUERIES
        checks |= module.CHECKS
    return queries, checks
