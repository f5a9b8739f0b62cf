"""All queries of the library outside the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from . import functions, operators, sources, streaming  # noqa: F401  each registers its queries
from .registry import REGISTRY


def queries() -> dict[str, Callable]:
    return {k: q.build for k, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.oracle for k, q in REGISTRY.items() if q.oracle}


def coverage() -> dict[str, list[str]]:
    """Inventory entry to the names of the queries that cover it."""
    out: dict[str, list[str]] = {}
    for q in REGISTRY.values():
        for item in q.covers:
            out.setdefault(item, []).append(q.name)
    return out
