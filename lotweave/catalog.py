"""All of the engine's queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from lotweave.plans import district_queries, lot_queries, name_queries, space_queries

MODULES = [lot_queries, name_queries, space_queries, district_queries]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in m.ORACLE.items()}
