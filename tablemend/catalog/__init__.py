"""Registered queries: each operator on the given tables, next to the SQL it must equal."""

from importlib import import_module

from .registry import oracle_sql, queries

for _part in ("profile", "repair", "encode", "neighbours", "models", "files"):
    import_module(f"{__name__}.{_part}")

__all__ = ["oracle_sql", "queries"]
