"""Named queries of the engine, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from colloquy.plans import catalog, hearing, language, linking, records, scoring, shaping, training

_MODULES = (catalog, records, shaping, scoring, linking, hearing, language, training)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.SQL.items()}
