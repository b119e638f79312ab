"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from navloom.plans.views import with_views


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    run: Callable
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, ids: str, views: str = "", sql: str | None = None):
    """Register a query under its name, with the operators it covers and its SQL twin."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        text = with_views(views.split(), sql) if sql else None
        QUERIES[name] = Query(name, tuple(ids.split()), fn, text)
        return fn

    return add
