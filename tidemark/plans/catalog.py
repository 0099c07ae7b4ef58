"""All queries of the engine by name, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import importlib

from .registry import ORACLE_SQL, QUERIES

for _name in ("ingest", "pricing", "measure", "evaluate", "wallets", "signals"):
    importlib.import_module(f"tidemark.plans.{_name}")

__all__ = ["ORACLE_SQL", "QUERIES"]
