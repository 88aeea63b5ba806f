"""Registered queries with their DuckDB twins."""

from . import graph, index, metadata, more, passages, rules, search, stores

_MODULES = (metadata, search, graph, rules, passages, more, index, stores)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
