"""Registered queries with the SQL that gives the same result."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("text_queries", "search_queries", "url_queries", "crawl_queries", "stream_queries")


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        out.update(getattr(import_module(f"fathom.catalog.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
