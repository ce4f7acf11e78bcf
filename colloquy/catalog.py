"""Where operators register their queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, directory) under a name."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if oracle:
            from .plans.oracle import CTES

            ORACLES[name] = f"with {CTES}{oracle if oracle.startswith(',') else chr(10) + oracle.strip()}"
        return f

    return register
