"""All registered queries with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("text_queries", "join_queries", "rule_queries", "page_queries", "guard_queries", "verdict_queries", "veto_queries", "tree_queries", "script_queries", "impact_queries", "decision_queries", "corpus_queries")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _load() -> None:
    """Modules register their queries when they are imported."""
    for name in MODULES:
        import_module(f".{name}", __package__)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, files, findings: how many claims of each document lead nowhere."""
    return queries()["link_findings"](spark, sf_dir)
