"""All registered queries of the notice engine."""

from __future__ import annotations

from bidstream.plans import cases, ingest, inventories, lexicons, markup, records, relations, revisions, searching, structures, texts, values

_MODULES = (searching, revisions, texts, relations, ingest, records, lexicons, markup, structures, inventories, values, cases)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
