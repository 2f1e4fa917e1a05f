"""All queries of the engine, their SQL, and what of the inventory each covers."""

from __future__ import annotations

from .queries import corpus, flows, governed, ledger, models, profiles, timeline, written

FAMILIES = (profiles, ledger, timeline, models, corpus, governed, flows, written)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}
for family in FAMILIES:
    QUERIES |= family.register.queries
    ORACLE_SQL |= family.register.sql
    COVERS |= family.register.covers
