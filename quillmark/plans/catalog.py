"""All queries over the shared tables, with their SQL."""

from __future__ import annotations

from quillmark.plans import ledger_queries, market_queries, token_queries

MODULES = [ledger_queries, token_queries, market_queries]
QUERIES: dict = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
