"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query; ``sql`` is its equivalent for another engine."""

    def put(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def load() -> None:
    """Import the modules that register queries."""
    from importlib import import_module

    for name in MODULES:
        import_module(f"corpusloom.{name}")


MODULES = (
    "operators.symbols",
    "operators.causal",
    "operators.matching",
    "operators.markup",
    "operators.batching",
    "operators.tensors",
    "operators.words",
    "operators.codec",
    "operators.models",
    "operators.contexts",
    "operators.datasets",
    "operators.dictionary",
    "operators.wordtypes",
    "operators.coding",
    "operators.articles",
    "operators.online_models",
    "operators.candidates",
    "operators.markers",
    "sources.sinks",
    "streaming.online",
)
