"""All queries of the engine and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from .catalog import ORACLES, QUERIES
from .operators import accounts, audit, bias, cities, clusters, correlation, fairness, history, insights, latent, posts, retention, story, temporal, vectors  # noqa: F401  they register themselves
from .streaming import ingest, profiles, series  # noqa: F401
from .streaming import queries as streams  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
