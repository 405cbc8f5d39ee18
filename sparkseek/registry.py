"""The queries of the search engine's own operators, by name, and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("sparkseek.plans.catalog",)
FLAGSHIP = "hybrid_strong"


def _all(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(m), attr)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
