"""The queries of this subpackage, by name, and their DuckDB SQL where there is any."""

from importlib import import_module

MODULES = ("langid", "chat", "pieces", "neardup", "pii", "substrings", "decontaminate", "toxicity", "webp", "warc", "pq", "urlrep", "ranked")


def _all(attr: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"sparkseek.llm.{m}"), attr, {})
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
