"""All queries of the core and their SQL, by name."""

from __future__ import annotations

from tilewright.plans import data, features, rasters, slides, tasks

MODULES = (data, slides, features, tasks, rasters)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}
