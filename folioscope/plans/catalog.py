"""Register of all queries of the block operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("texts", "scores", "pages", "reports", "audits")


def query(sql: str | None = None, name: str | None = None):
    """Register a callable (spark, sf_dir) -> DataFrame, with its DuckDB SQL if there is one."""

    def put(f: Callable) -> Callable:
        key = name or f.__name__
        if key in _QUERIES:
            raise ValueError(f"query {key} is registered twice")
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return put


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"folioscope.plans.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    _load()
    return _SQL
