"""All registered queries of the temporal engine, and their DuckDB SQL."""

from __future__ import annotations

from . import building, diagnoses, retrieval, temporal, texts  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
