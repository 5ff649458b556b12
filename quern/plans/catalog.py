"""Registry of the graph engine's queries and of the SQL that states each result."""

from __future__ import annotations

from quern.plans import queries_diff, queries_graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (queries_graph, queries_diff):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
