"""Query plans of the core by name."""

from __future__ import annotations

import importlib

_MODULES = ("data_quality", "messages", "analytics", "star", "streams", "records", "upkeep")


def core_queries() -> dict:
    from quaylight.plans.registry import QUERIES

    for m in _MODULES:
        importlib.import_module(f"quaylight.plans.{m}")
    return dict(QUERIES)


def core_sql() -> dict[str, str]:
    from quaylight.plans.registry import SQL

    core_queries()
    return dict(SQL)
