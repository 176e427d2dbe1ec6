"""Named queries over the engine's operators, and the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Add a query under its name, with its SQL where SQL can express it."""

    def add(query: Query) -> Query:
        _queries[name] = query
        if oracle:
            _oracles[name] = oracle
        return query

    return add


#: Modules whose import registers queries.
MODULES = ("pagelake.plans.lake", "pagelake.plans.codecs", "pagelake.plans.formats", "pagelake.plans.tables")


def queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(name)
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_oracles)
