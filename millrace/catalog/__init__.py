"""Registered queries with their DuckDB counterparts."""

from __future__ import annotations

from importlib import import_module

from millrace.catalog.registry import ORACLE, QUERIES

MODULES = [
    "profiling",
    "preparation",
    "evaluation",
    "runs",
    "spending",
    "board",
    "passages",
    "extraction",
    "sources",
    "modelling",
    "live",
]


def load_all():
    for name in MODULES:
        import_module(f"millrace.catalog.{name}")
    return QUERIES, ORACLE
