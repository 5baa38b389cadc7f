"""Every registered query of the analytics engine and the SQL that says the same."""

from __future__ import annotations

from . import finders, graphs, labels, more, offers, relational, resolution, shop, streams, web  # noqa: F401  each registers its queries
from .projections import QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
