"""Composed queries: the served operations and the registered driver queries."""

from __future__ import annotations


def _load() -> None:
    from . import ingest_queries, relational_queries, scalar_queries, vote_queries  # noqa: F401


def queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .registry import SQL

    _load()
    return dict(SQL)
