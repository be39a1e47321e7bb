"""All queries of the core with their SQL."""

from __future__ import annotations

from siltstone.plans import store_queries, training

QUERIES = {**store_queries.QUERIES, **training.QUERIES}
SQL = {**store_queries.SQL, **training.SQL}
