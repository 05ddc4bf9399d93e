"""Registered queries and the SQL that states their result."""

from __future__ import annotations

from scriptorium.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load"]


def load() -> tuple[dict, dict]:
    """Import every area and return (queries, reference SQL)."""
    from scriptorium.catalog import (  # noqa: F401
        activity,
        citation,
        learning,
        matching,
        news,
        quality,
        review,
        series,
        sources,
        streams,
    )

    return QUERIES, ORACLES
