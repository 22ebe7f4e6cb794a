"""All registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tarnwork.llm import oracles, queries


def collect() -> tuple[dict, dict]:
    """Queries and SQL by name."""
    return dict(queries.QUERIES), dict(oracles.ORACLES)
