"""Registered queries and, where SQL can express them, the same query in SQL."""

from __future__ import annotations

import importlib

MODULES = ("integrity", "text", "retrieval", "dialogue", "sync", "ops", "projections", "hydration")


def collect() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = importlib.import_module(f"loomspark.plans.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql
