"""Operators bound to the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from sluice.queries import gold, observe, quality, sources, tables

_MODULES = (sources, quality, tables, gold, observe)
QUERIES = {name: q for m in _MODULES for name, q in m.BOOK.queries.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.BOOK.sql.items()}
