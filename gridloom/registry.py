"""All queries and oracle SQL of the core library by name."""

from __future__ import annotations

from gridloom.plans import analysis, counts, decisions, descriptive, evaluation, forests, grids, mixed, resampling, screens

_MODULES = (descriptive, evaluation, analysis, decisions, counts, mixed, forests, grids, resampling, screens)
QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
