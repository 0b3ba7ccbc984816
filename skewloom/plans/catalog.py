"""All registered queries and their SQL, without the training-data ones."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame under its function's name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


for _family in ("selection", "labels", "vectors", "distributions", "splits", "reports", "texts", "statistics", "loops", "analysis", "sources"):
    importlib.import_module(f"skewloom.plans.{_family}_queries")
