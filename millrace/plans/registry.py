"""All registered queries and their SQL twins, gathered from the modules of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ("profiling", "relational", "relationships", "privacy", "warehouse", "lineage", "usage", "snapshots", "staging", "modelling", "propagation", "texts", "scoring", "checks", "retrieval", "inputs", "streams")


def _books():
    for name in MODULES:
        yield import_module(f"millrace.plans.{name}").book


def queries() -> dict:
    found = {}
    for book in _books():
        found |= book.queries
    return found


def oracle_sql() -> dict:
    found = {}
    for book in _books():
        found |= book.sql
    return found
