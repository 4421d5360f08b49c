"""All queries of the engine and their SQL for DuckDB, by name."""

from __future__ import annotations

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
