"""All registered queries of the core and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["trees", "retrieval", "curation", "flows", "ledger"]


def collect() -> tuple[dict, dict]:
    """Queries and SQL of all modules, by name."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"tarnwork.plans.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
