"""Registry of this package's queries and the SQL some of them are checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

MODULES = ("chat", "quality", "urls", "toxicity", "pieces", "neardup", "mixture", "language", "sharding", "fingerprints",
           "alignment", "turns", "pii")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def load_all() -> tuple[dict[str, Query], dict[str, str]]:
    for name in MODULES:
        importlib.import_module(f"tapeloom.llm.{name}")
    return QUERIES, ORACLE
