"""All queries and their SQL by name."""

from __future__ import annotations

from lumenreel.plans import checks, files, more, ranking, records, sequences, upkeep

_MODULES = (ranking, records, sequences, checks, files, more, upkeep)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
