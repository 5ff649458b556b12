"""The queries of the training-data operators, each with its SQL where SQL can state it."""

from __future__ import annotations

from quern.llm import queries_tables, queries_text

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (queries_text, queries_tables):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
