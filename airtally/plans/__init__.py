"""Named queries over the given tables."""

from __future__ import annotations

import importlib

from airtally.plans import registry

_MODULES = (
    "queries_household",
    "queries_matching",
    "queries_ingest",
    "queries_segments",
    "queries_reports",
    "queries_privacy",
    "queries_streaming",
)


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"airtally.plans.{name}")


def all_queries():
    _load()
    return dict(registry.QUERIES)


def all_sql():
    _load()
    return dict(registry.SQL)
