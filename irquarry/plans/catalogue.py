"""All registered queries."""

from __future__ import annotations

import importlib

from irquarry.plans.registry import ORACLE, QUERIES, Plan

_MODULES = (
    "scoring",
    "texts",
    "structure",
    "outcomes",
    "matching",
    "retrieval",
    "listings",
    "graphs",
    "repair",
    "stores",
    "runs",
)


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"irquarry.plans.{name}")


def queries() -> dict[str, Plan]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLE)
