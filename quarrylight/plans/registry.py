"""Collects the queries and oracle statements of every plan module."""

from __future__ import annotations

from quarrylight.plans import base


def queries() -> dict:
    return {name: q.run for name, q in base.collected().items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in base.collected().items() if q.sql}
