"""Registry of the engine's queries and of the SQL that checks them."""

from __future__ import annotations

from tidewell.plans import datasets, detection, live, records, scoring, signals, text_queries

_PARTS = (detection, datasets, text_queries, scoring, records, live, signals)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict = {k: v for p in _PARTS for k, v in p.SQL.items()}
